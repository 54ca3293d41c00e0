"""Spelling variants against brute force over all pairs, and edge cases."""

from __future__ import annotations

import collections
import re
import zlib
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promptweave.llm import spelling
from promptweave.llm.spelling import compose, spelling_groups, spelling_report, vocabulary


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) > len(v):
        u, v = v, u
    i = next((k for k, (a, b) in enumerate(zip(u, v)) if a != b), len(u))
    return u[i + (len(u) == len(v)) :] == v[i + 1 :]


def grouped(counts):
    near = collections.defaultdict(list)
    for u, v in combinations(counts, 2):
        if one_edit(u, v):
            near[u].append(v)
            near[v].append(u)
    best = {w: min(((-counts[v], v) for v in near[w]), default=(0, None)) for w in counts}
    form = {w: v if v and -n >= 10 * counts[w] else None for w, (n, v) in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def words(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=4, max_size=4)), st.sets(st.text("abé", min_size=5, max_size=5)))
def test_composition(equal, longer):
    pairs = list(compose(sorted(equal), sorted(longer)))
    wanted = {tuple(sorted(p)) for p in combinations(equal, 2) if one_edit(*p)}
    wanted |= {tuple(sorted((u, v))) for u in equal for v in longer if one_edit(u, v)}
    assert len(pairs) == len(wanted) and {tuple(sorted(p)) for p in pairs} == wanted


VOCABULARY = {
    "spelling": 5000, "speling": 400, "spellling": 30, "spellin": 3, "spelking": 400, "apelling": 2, "spellings": 500,
    "aaaaaaa": 10, "aaaaaaaa": 100, "aaaaaaaaa": 1000, "aaaaaab": 10, "baaaaaa": 100,
    "höflich": 40, "hoflich": 4, "höfliche": 400, "×××××××": 2, "alone": 7, "a": 9, "b": 90, "": 2,
}


@pytest.mark.parametrize("crowd", [1, 2, 20_000])
def test_groups(spark, crowd):
    """Ties, chains of forms and letters put in beside their like; crowded groups give the same."""
    counts = {w: n for w, n in VOCABULARY.items() if w}
    assert found(spelling_groups(words(spark, counts), crowd=crowd)) == grouped(counts)


def test_one_hot_state(spark):
    """Thousands of words that share one half, beyond the size of a group."""
    counts = {f"shared{''.join(chr(97 + (i // 26**k) % 26) for k in range(6))}": 2 + i % 40 for i in range(0, 30_000, 7)}
    plain, split = (found(spelling_groups(words(spark, counts), crowd=c)) for c in (1 << 30, 100))
    assert plain == split and sum(v[3] for v in plain.values()) > 1000


def brute_vocabulary(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_documents(spark):
    long = "ab" * 20_000
    text = "Largest ÉCLAIRS largest-largest İstanbul ×÷letters under_scored short Words, " * 30
    rows = [(i, text + " ".join(f"Word{'abc'[i % 3]}{'xyz'[j % 3]}ing" for j in range(200))) for i in range(12)]
    rows += [(20, f"{long} {long}"), (21, f"{long}b {long}b"), (21, None), (None, "Largest largest"), (22, ""), (23, " \n1")]
    rows += rows[:2]
    df = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id long, text string, word string, n int")
    counts = brute_vocabulary(rows)
    assert {r["word"]: r["n"] for r in vocabulary(df).collect()} == counts and len(counts) > 10
    assert found(spelling_report(df)) == grouped(counts)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_report(none).collect() == []
    assert spelling.near_words(words(spark, {"only": 3})).collect() == []
