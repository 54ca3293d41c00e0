"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
from os.path import commonprefix

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from promptweave.llm import repeats as repeats_module
from promptweave.llm import simhash as simhash_module
from promptweave.llm.common import connected_components, in_order, join_checked
from promptweave.llm.decontaminate import cut_contaminated, decontamination_report, drop_contaminated
from promptweave.llm.main_text import _neighbours, main_text, page_lines
from promptweave.llm.mixing import mix_sources, repetition_rates
from promptweave.llm.order_minhash import fingerprints, with_next
from promptweave.llm.pii import pii_report, sanitise
from promptweave.llm.quality import document_statistics, fit_boosted_trees, fit_quality, keep_quality, score_documents
from promptweave.llm.queries import TOKENIZER
from promptweave.llm.repeats import repeats_report, without_repeats
from promptweave.llm.simhash import keep_one_per_component, simhash_components
from promptweave.llm.tokens import ChunkEncoder, read_tokens, write_tokens
from promptweave.llm.warc import assemble_captures, parse_records, read_archives, write_archives
from promptweave.session import scratch_path
from tests.llm import brute

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score double, fp long, key string, rate double, copy int, spans string, gram string, at int, rank int"
)
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(60_000))
BENCH = "one two three four five six seven eight nine ten eleven twelve"


def frame(spark, rows, schema=DOCS):
    width = len(schema.split(", "))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


ROWS = [
    (1, "Mixed CASE text, of some words; and a few more.", "en", "a", 40),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", len(LONG)),
    (5, "repeated row", "en", "a", 12),
    (5, "repeated row", "en", "a", 12),
    (None, "no id here at all", "en", None, 17),
    (7, "éà " * 300 + "ß𝔘 " * 200, "fr", "b", 1700),
    (8, f"Intro. {BENCH.upper()}! and the end", "en", "c", 80),
    (9, " \n\t ", "en", "c", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(10, BENCH), (2, BENCH), (3, "no id"), (None, None), (4, ""), (5, "...")], "item_id long, text string"
    )


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1), (2, 0), (3, None), (None, 1), (4, 0), (4, 1), (5, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda d: (d is not None, d))


ALL = [None, 1, 2, 3, 4, 5, 5, 7, 8, 9]


def test_mixing(docs, none):
    mixed = mix_sources(docs, epochs=3.0).collect()
    by_id = {}
    for r in mixed:
        by_id.setdefault(r["doc_id"], []).append(r["copy"])
    for d, copies in by_id.items():
        again = 2 if d == 5 else 1
        assert sorted(copies) == sorted(list(range(1, max(copies) + 1)) * again)
    keys = [r["mix_key"] for r in mixed]
    assert len(set(keys)) >= len(keys) - len(by_id.get(5, []))
    assert mix_sources(none).collect() == []
    rates = {r["source"]: r["rate"] for r in repetition_rates(docs, {"a": 1.0, "b": 3.0, "z": 1.0}).collect()}
    assert rates[""] == 0.0 and rates["c"] == 0.0 and rates["a"] > rates["b"] > 0


def test_mixing_meets_its_rates(spark):
    many = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source")
    )
    n = {r["source"]: r["n"] for r in mix_sources(many, {"hot": 1.0, "cold": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert n["hot"] == pytest.approx(20_000, rel=0.03) and n["cold"] == pytest.approx(20_000, rel=0.03)
    large = mix_sources(many.limit(50), {"hot": 1.0, "cold": 1.0}, epochs=900.0).count()
    assert large == pytest.approx(45_000, rel=0.05)


def test_fingerprints(docs, none):
    rows = fingerprints(docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in rows) == [(d is not None, d) for d in ALL]
    texts = {1: ROWS[0][1], 4: LONG, 3: "", 2: "", 8: ROWS[8][1], 7: ROWS[7][1]}
    after = {8: texts[7], 4: texts[3], 1: "no id here at all"}
    for r in rows:
        if r["doc_id"] in after:
            t = texts[r["doc_id"]]
            half = len(t) // 2
            edited = t[: len(t) - half] + after[r["doc_id"]][:half]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    empties = [r for r in rows if r["doc_id"] in (2, 3)]
    assert {r["fingerprint"] for r in empties} == {""}
    assert [r["near_next"] for r in rows if r["doc_id"] == 3] == [1.0]
    assert fingerprints(none).collect() == []


def test_fingerprint_of_one_row_and_of_repetition(spark):
    one = fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    rows = [(3, "a b c d e " * 50), (2, "a b c d e " * 25), (1, "other words entirely different from those")]
    found = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0.05 < found[3]["near_next"] < 0.6
    assert found[2]["near_next"] == 0.0


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_next_rows_in_any_number_of_ranges(spark, buckets):
    ids = [5] * 20 + [None] * 10 + list(range(-20, 60, 3)) + [2**60, 2**60 + 1]
    df = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string").repartition(4)
    rows = with_next(df, ["doc_id", "text"], buckets).collect()
    order = {(r["doc_id"], r["text"]): (r["_next"]["doc_id"], r["_next"]["text"]) for r in rows}
    assert len(rows) == len(order) == len(ids)
    at = start = next(k for k in order if k[0] == 2**60 + 1)
    seen = []
    while at not in seen[:1]:
        seen.append(at)
        at = order[at]
    assert at == start and len(seen) == len(ids)
    expected = sorted((d for d in ids), key=lambda d: (d is None, -(d or 0)))
    assert [d for d, _ in seen] == expected


def test_order_counts(spark):
    words = [f"word{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    mixed = sorted(words)
    rows = [(3, " ".join(words)), (2, " ".join(moved)), (1, " ".join(mixed))]
    found = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0.2 < found[3]["near_next"] < 0.95
    assert found[2]["near_next"] < 0.2


PAGES = "page_id long, url string, html string, record_id string, payload_digest string, path string, lines int"


def test_warc(spark):
    odd = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabc"
    rows = [
        (1, "http://a.example/p?q=1", "<p>ä€𝔘</p>"), (2, "http://a.example/q", "<p>ä€𝔘</p>"), (3, None, None),
        (4, "not a url\r\nX: y", ""), (5, "http://b.example", odd), (None, "http://c.example/", "<b>no id</b>"),
        (6, "http://a.example/long", "<p>" + LONG), (9, "http://d.example/t", "tie"), (9, "http://d.example/t", "tie"),
    ]
    folder = scratch_path(spark, "warc")
    write_archives(frame(spark, rows, PAGES).repartition(2), folder)
    found = assemble_captures(read_archives(spark, folder)).collect()
    assert len(found) == len(rows)
    assert all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 and r["capture"]["digest_holds"] for r in found)
    by_page = {r["metadata"][0]["page_id"]: r for r in found}
    assert bytes(by_page[5]["capture"]["payload"]).decode() == odd
    assert bytes(by_page[6]["capture"]["payload"]).decode() == "<p>" + LONG
    assert by_page[1]["capture"]["record_type"] == "revisit" and by_page[1]["metadata"][0]["refers_to_page"] == 2
    assert by_page[3]["capture"]["record_type"] == "revisit" and by_page[3]["metadata"][0]["refers_to_page"] == 4
    assert by_page[1]["capture"]["payload_digest"] == by_page[2]["capture"]["payload_digest"]
    assert by_page[9]["capture"]["record_type"] == "response"
    empty = scratch_path(spark, "warc")
    write_archives(frame(spark, [], PAGES), empty)
    assert assemble_captures(read_archives(spark, empty)).collect() == []


def test_damaged_archives_are_an_error():
    with pytest.raises(ValueError, match="cut off"):
        list(parse_records(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n"))
    with pytest.raises(ValueError, match="no WARC record"):
        list(parse_records(b"something else\r\n\r\n"))


PII = [
    "mail a@b.co, c.d@e.f.gh+i@j.kl and é1@x.yz",
    "ip 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 000001.2.3.4 1234567890123.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 5",
    "call +1 (212) 555-0100 or +49.30.1234567 or +12 or ++441632960961",
    "+4111 1111 1111 1111 and 10.0.0.1.",
    "1" * 5000 + "." * 10 + "a" * 30_000 + "@" + "b." * 3000 + "c",
    "😀 a@b.co 😀 10.0.0.1",
]


def test_pii_spans_are_those_of_the_patterns(spark):
    docs = frame(spark, [(i, t) for i, t in enumerate(PII)])
    for r in pii_report(docs).collect():
        expected = brute.base_spans(PII[r["doc_id"]])
        listed = [s for s in r["spans"].split(",") if s and not s.startswith("term")]
        assert listed == [f"{k}:{a}:{b}" for k, a, b in expected]


def test_pii(docs, none):
    assert ids(pii_report(docs)) == ALL
    assert pii_report(none).collect() == []
    assert sanitise(docs).columns == docs.columns
    assert sorted(r["text"] or "" for r in sanitise(docs).collect()) == sorted(r[1] or "" for r in ROWS)


def test_disclosing_terms_are_generalised_or_removed(spark):
    filler = [(100 + i, "the plain talk of the day goes on and on") for i in range(60)]
    near = [(i, f"the boss Zarquon, writes from z{'q'}@x.org the day {i}") for i in range(5)]
    docs = spark.createDataFrame(near + filler + [(50, "also Zarquon here")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii_report(docs).collect()}
    assert rows[0]["n_term"] >= 1 and "term:9:16" in rows[0]["spans"].split(",")
    assert rows[50]["spans"] == "" and rows[100]["spans"] == ""
    text = {r["doc_id"]: r["text"] for r in sanitise(docs).collect()}
    assert text[0] == "the  [TERM],   [EMAIL] the day 0"
    assert text[100] == filler[0][1]


def test_terms_of_any_length(spark):
    """One letter, 41 letters, and a sentence in a script without blanks, each of one document only."""
    long, sentence = "x" * 41, "文" * 30 + "書" * 30
    rows = [(1, f"q and {long} with {sentence} of ann@mail.example.org.")]
    rows += [(i, f"and with of the rest {'ab'[i % 2]}") for i in range(2, 60)]
    found = {r["doc_id"]: r for r in pii_report(frame(spark, rows)).collect()}
    text = rows[0][1]
    terms = {s[5:] for s in found[1]["spans"].split(",") if s.startswith("term")}
    wanted = {f"{text.index(w)}:{text.index(w) + len(w)}" for w in ("q", long, sentence)}
    assert terms == wanted and found[1]["n_term"] == 3


def test_terms_disclose_wherever_they_stand(spark):
    """A value that one or two documents hold, and a term far from it, more than once."""
    far = "the day goes on and on " * 10
    rows = [(i, "the plain talk of the day goes on and on") for i in range(100, 160)]
    rows += [(1, f"Zarquon {far} to q@x.org or 10.1.2.3 {far} zarquon"), (2, f"{far} p@y.org {far} Vogon")]
    rows += [(3, f"Vogon {far} p@y.org"), (4, "nobody here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii_report(docs).collect()}
    terms = {d: {s[5:] for s in r["spans"].split(",") if s.startswith("term")} for d, r in found.items()}
    for d, text in rows:
        places = [(w, text.lower().find(w)) for w in ("zarquon", "vogon") if w in text.lower()]
        places += [(w, text.lower().rfind(w)) for w, _ in places]
        assert {f"{a}:{a + len(w)}" for w, a in places} <= terms[d]
        assert not any(text[int(a) : int(b)] in ("the", "day", "on") for a, b in (s.split(":") for s in terms[d]))
    assert found[4]["n_term"] == found[100]["n_term"] == 0 and found[1]["n_term"] == 4


def test_repeats(spark, docs, none):
    plain = [(r[0], r[1]) for r in ROWS]
    found = sorted((tuple(r) for r in repeats_report(docs).collect()), key=str)
    expected = sorted(((d, *e) for (d, _), e in zip(plain, brute.removed_repeats(plain), strict=True)), key=str)
    assert found == expected
    assert repeats_report(none).collect() == []
    assert without_repeats(none).collect() == []


@pytest.mark.parametrize("crowd", [repeats_module.CROWD_FRAGMENTS, 2])
def test_repeats_of_every_kind(spark, monkeypatch, crowd):
    """With crowded anchors split, and without."""
    monkeypatch.setattr(repeats_module, "CROWD_FRAGMENTS", crowd)
    rng = np.random.default_rng(1)

    def words(n):
        return "".join(chr(97 + c) for c in rng.integers(0, 26, n))

    passage, edge = words(900), words(399)
    rows = [words(2000) + passage + words(300), passage[100:600], words(50) + passage + words(50) + passage]
    rows += [edge + words(500), words(500) + edge, "z" * 3000, "z" * 399 + "y", "ab" * 700, words(20) + "z" * 450]
    base = words(3000)
    for _ in range(30):  # near copies with an edit each
        at = int(rng.integers(0, 3000))
        rows.append(base[:at] + words(3) + base[at + 2 :])
    rows += ["é" + passage[:500], words(400)] * 2
    docs = [(i, t) for i, t in enumerate(rows)]
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats_report(frame(spark, docs)).collect()}
    assert found == {d: e for (d, _), e in zip(docs, brute.removed_repeats(docs), strict=True)}
    left = {r["doc_id"]: r["text"] for r in without_repeats(frame(spark, docs)).collect()}
    assert left[5] == "" and left[3] == rows[3]


def test_no_crowd_is_gathered(spark, monkeypatch):
    """A passage with other text around it each time: its edge has a core in common and differs beside it."""
    monkeypatch.setattr(repeats_module, "CROWD_FRAGMENTS", 20)
    solved, largest = repeats_module._solved, []

    def watched(pieces, n_pieces):
        largest.append(pieces.groupBy("crowd").count().agg({"count": "max"}).first()[0] or 0)
        return solved(pieces, n_pieces)

    monkeypatch.setattr(repeats_module, "_solved", watched)
    rng = np.random.default_rng(2)

    def words(n):
        return "".join(chr(97 + c) for c in rng.integers(0, 26, n))

    passage, beside = words(1200), words(30)
    docs = [(i, words(500) + (beside if i % 9 == 0 else "") + passage + words(500)) for i in range(60)]
    docs += [(60, docs[0][1]), (61, "x" + docs[1][1][:1500])]
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats_report(frame(spark, docs)).collect()}
    assert found == {d: e for (d, _), e in zip(docs, brute.removed_repeats(docs), strict=True)}
    assert len(largest) == 2 and max(largest) <= 20


def test_a_wrong_hash_is_found_out(monkeypatch):
    """With a hash that is the same for all bytes, sorting falls back on comparing them."""
    monkeypatch.setattr(repeats_module, "_TABLE", np.zeros(256, np.uint64))
    pieces = [b"abcabd", b"abcabe", b"abx"]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    length = np.array([6, 6, 3])
    start = np.array([0, 6, 12])
    local = np.concatenate([np.arange(n) for n in length])
    order, shared = repeats_module.sorted_suffixes(data, local, start, length, np.array([1, 1, 1]))
    assert order.tolist() == [0, 1, 2] and shared.tolist() == [-1, 5, 2]


def test_tokens(spark, docs, none):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    folder = scratch_path(spark, "tokens")
    manifest = write_tokens(docs, folder, TOKENIZER, partitions=4)
    found = sorted((tuple(r) for r in read_tokens(spark, folder).collect()), key=lambda r: r[1])
    plain = sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    expected = brute.token_rows([(i, t) for i, (_, t) in enumerate(plain)], tokenizer)
    assert [r[1:] for r in found] == [r[1:] for r in expected]
    assert [r[0] for r in found] == [d for d, _ in plain]
    assert sum(m["docs"] for m in manifest) == len(ROWS)
    folder = scratch_path(spark, "tokens")
    by_source = docs.withColumn("key", F.coalesce("source", F.lit("z")))
    found = read_tokens(spark, folder, write_tokens(by_source, folder, TOKENIZER, partitions=3, order=["key", "n_chars"]))
    found = sorted((tuple(r) for r in found.collect()), key=lambda r: r[1])
    assert sorted((r[0] or 0, *r[2:]) for r in found) == sorted((plain[r[0]][0] or 0, *r[2:]) for r in expected)
    assert found[-1][0] is None and found[-2][0] == 2
    assert [r[1] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1]]
    hot = frame(spark, [(None, "the same text")] * 2000 + [(7, f"text {i}") for i in range(50)]).repartition(4)
    folder = scratch_path(spark, "tokens")
    manifest = write_tokens(hot, folder, TOKENIZER, partitions=8)
    assert max(m["docs"] for m in manifest) < 700
    assert [r["doc_id"] for r in read_tokens(spark, folder).orderBy("start").collect()] == [None] * 2000 + [7] * 50
    folder = scratch_path(spark, "tokens")
    assert read_tokens(spark, folder, write_tokens(none, folder, TOKENIZER)).collect() == []


@pytest.mark.parametrize(
    "text",
    ["It's  <|endoftext|> I'LL x　y", "áé ́b", "ΟΔΟΣ. Σ", "x\x1cy\x0bz\r\n\r\n'", "日本語テキスト 12,345.67", " İstanbul ﬁ"],
)
def test_chunks_encode_like_whole_texts(text):
    encoder = ChunkEncoder(TOKENIZER)
    expected = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == expected


HTML = """<html><head><title>T</title></head><body><header>Site</header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We bake</div><article><header><h1>Title &amp; more</h1></header><p>First <b>bold
<br>next<p>Second<aside>Side</aside><form><input>Ask</form><div class="ad">Buy</div><script>var a="<p>no";</script>
<table><tr><td>c1<td>c2</table></article><div id="comments"><article>I disagree</article></div><footer>&copy;</footer>"""


def test_lines_of_a_page():
    found = [t for t, role in page_lines(HTML) if role == 1]
    assert found == ["Title & more", "First bold next", "Second", "c1", "c2"]
    assert page_lines(None) == [] and page_lines("") == []
    assert [t for t, _ in page_lines("plain <i>te</i>xt &lt;p&gt; <p")] == ["plain text <p> <p"]


@pytest.mark.parametrize(
    "html,lines",
    [
        ("<html><head><title>t</title><body><article><p>one<p>two", ["one", "two"]),
        ("<head><meta x><link y><body><p>one", ["one"]),
        ("<article><p>one<iframe src=x> two<p>three</article>", ["one two", "three"]),
        ("<article><p>one<iframe src=x>no</iframe> two", ["one two"]),
        ("<article><p>where <math><mi>x</mi></math> is <svg><text>real</text></svg> <object>now</object>", ["where x is real now"]),
        ('<article><section id="related-work"><p>a</section><p class="share-price">b<div class="search">c</div>', ["a", "b", "c"]),
        ('<article><p>a<div class="share-buttons">no</div><div class="related">no</div><div class="ad-box">no</div><p>b', ["a", "b"]),
        ("<article><p>one<script>var x = 1; <p>two</article>", ["one", "two"]),
        ("<title>t<p>one<title>u</title><p>two", ["two"]),
        ("<article><p>a<template>no</template>b<noscript>no</noscript>c<textarea>no", ["abcno"]),
    ],
)
def test_no_text_is_lost(html, lines):
    assert [t for t, _ in page_lines(html)] == lines


def test_many_open_elements():
    assert len(page_lines("<article>" + "<iframe><p>a" * 20_000)) == 20_000


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_neighbours_over_ranges(spark, partitions):
    """Runs of one digest that end within, at and beyond the bounds of ranges."""
    rng = np.random.default_rng(partitions)
    rows = [(h, f"/{p:03d}", int(d)) for h in "abc" for p, d in enumerate(np.repeat(rng.integers(0, 3, 14), rng.integers(1, 9, 14)))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = {tuple(r)[:3]: r["near"] for r in _neighbours(spark.createDataFrame(rows, "host string, path string, digest long")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for i, (host, path, digest) in enumerate(rows):
        earlier = next((r for r in rows[:i][::-1] if r[0] != host or r[2] != digest), None)
        later = next((r for r in rows[i + 1 :] if r[0] != host or r[2] != digest), None)
        beside = [r for r in (earlier, later) if r and r[0] == host]
        best = max(beside, key=lambda r: len(commonprefix([path, r[1]])), default=None)
        assert found[host, path, digest] == (best and best[2]), (host, path)


def test_main_text(spark):
    page = "<div>Shared top</div><div>Only {0}</div><div>Shared end</div>"
    rows = [
        (1, "http://h/a/1", page.format("one")), (2, "http://h/a/2", page.format("two")), (3, "http://h/b", "<p>lone"),
        (4, None, None), (None, "http://h/a/2", page.format("two")), (5, "http://other/a/1", page.format("five")),
        (6, "http://[bad", "<article>x<p>y</article>"), (6, "http://[bad", "<article>x<p>y</article>"),
        (7, "http://long/x", "".join(f"<p>line {i}" for i in range(20_000))),
        (8, "http://long/y", "".join(f"<p>line {i}" for i in range(5, 19_000)) + "<p>own"),
    ]
    found = {}
    for r in main_text(frame(spark, rows, PAGES)).collect():
        found.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert found[1] == ["Only one"] and found[2] == ["Only two"] and found[None] == ["Only two"]
    assert found[3] == ["lone"] and found[4] == [""] and found[6] == ["x\n\ny"] * 2
    assert found[5] == ["Shared top\n\nOnly five\n\nShared end"]
    assert found[8] == ["own"] and found[7][0].startswith("line 0\n\nline 1\n\nline 2\n\nline 3\n\nline 4\n\nline 19000")
    assert main_text(frame(spark, [], PAGES)).collect() == []


def test_pages_are_compared_with_other_lines(spark):
    """Copies side by side, pages that share one path, and pages without lines."""
    page = "<div>Top</div><div>Only {0}</div><div>End</div>"
    rows = [(i, f"http://copies/a/{i}", page.format("one")) for i in (1, 2, 3, 4)]
    rows += [(5, "http://copies/a/35", ""), (6, "http://copies/z", page.format("two"))]
    rows += [(i, f"http://path/index.php?id={i}", page.format(i)) for i in (11, 12, 13)]
    rows += [(21, "http://same/a", page.format("x")), (22, "http://same/b", page.format("x"))]
    found = {r["page_id"]: r["text"] for r in main_text(frame(spark, rows, PAGES)).collect()}
    assert [found[i] for i in range(1, 7)] == ["Only one"] * 4 + ["", "Only two"]
    assert [found[i] for i in (11, 12, 13)] == ["Only 11", "Only 12", "Only 13"]
    assert found[21] == found[22] == "Top\n\nOnly x\n\nEnd"


def test_differencing_decides_in_pages_with_an_article(spark):
    page = "<div>Top</div><article><p>Both</p><p>Text {0}</p></article><div>Note {0}</div><div>End</div>"
    rows = [(i, f"http://h/a/{i}", page.format(i)) for i in (1, 2)]
    rows.append((3, "http://alone/a", page.format(3)))
    found = {r["page_id"]: r["text"].split("\n\n") for r in main_text(frame(spark, rows, PAGES)).collect()}
    assert found == {1: ["Both", "Text 1", "Note 1"], 2: ["Both", "Text 2", "Note 2"], 3: ["Both", "Text 3"]}


def test_decontamination(docs, none, bench):
    found = {r["doc_id"]: r for r in decontamination_report(docs, bench).collect()}
    assert found[8]["n_hit"] == 12 and found[8]["n_items"] == 2 and found[8]["contaminated"]
    assert found[8]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest()
    assert found[None]["n_hit"] == 2 and found[None]["n_items"] == 1
    assert found[2]["n_words"] == 0 and not found[2]["contaminated"]
    assert ids(decontamination_report(docs, bench)) == ALL
    assert decontamination_report(none, bench).collect() == []
    assert not any(r["contaminated"] for r in decontamination_report(docs, bench.limit(0)).collect())
    assert ids(drop_contaminated(docs, bench)) == [1, 2, 3, 4, 5, 5, 7, 9]
    assert ids(drop_contaminated(docs, bench.limit(0))) == ALL
    cut = {r["doc_id"]: r["text"] for r in cut_contaminated(docs, bench).collect()}
    assert cut[8] == "Intro. and the end" and cut[2] is None and cut[None] == "here at all" and cut[4] == LONG


def test_decontamination_in_blocks(docs, bench, monkeypatch):
    whole = sorted(map(str, decontamination_report(docs, bench).collect()))
    from promptweave.llm import decontaminate

    monkeypatch.setattr(decontaminate.window_blocks, "__defaults__", (2,))
    assert sorted(map(str, decontamination_report(docs, bench).collect())) == whole
    assert ids(drop_contaminated(docs, bench)) == [1, 2, 3, 4, 5, 5, 7, 9]


def test_blocks_agree_on_rows_that_come_in_another_order(spark, bench, monkeypatch):
    from promptweave.llm import decontaminate

    rows = [(i, f"Intro {i}. {BENCH}" if i % 3 == 0 else f"plain {i}") for i in range(60)]
    plain = frame(spark, rows).coalesce(1)
    shuffled = plain.mapInPandas(lambda batches: (b.sample(frac=1) for b in batches), plain.schema)
    whole = sorted(map(str, decontamination_report(plain, bench).collect()))
    monkeypatch.setattr(decontaminate.window_blocks, "__defaults__", (2,))
    assert sorted(map(str, decontamination_report(shuffled, bench).collect())) == whole


def test_simhash(docs, none):
    found = simhash_components(docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in found) == [(d is not None, d or 0) for d in ALL]
    blank = [r for r in found if r["doc_id"] in (2, 3, 9)]
    assert {(r["fingerprint"], r["component_id"]) for r in blank} == {("0" * 16, 2)}
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]
    assert simhash_components(none).collect() == []
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns and ids(kept) == [None, 1, 2, 4, 5, 7, 8]
    assert keep_one_per_component(none).collect() == []


def test_unlike_texts_stay_under_any_id(spark):
    """Null ids and shared ids are no reason to drop a text; copies of the kept row are."""
    words = [" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "green", "blue", "grey", "pink")]
    rows = [(None, words[0]), (None, words[1]), (None, words[2]), (5, words[3]), (5, words[4])]
    rows += [(5, words[3]), (None, words[0]), (9, words[0]), (9, words[0]), (3, words[1])]
    kept = keep_one_per_component(frame(spark, rows).repartition(3)).collect()
    found = sorted(((r["doc_id"], r["text"]) for r in kept), key=str)
    assert found == sorted([(9, words[0]), (3, words[1]), (None, words[2]), (5, words[3]), (5, words[4])], key=str)


def test_links_of_crowds():
    """Vantage points, plain comparison and bit flips connect what all pairs connect."""
    rng = np.random.default_rng(5)
    spread = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (4000, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    crowd = np.uint64(123456789) ^ flips
    near = spread[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    points = np.unique(np.concatenate([spread, crowd, near]))
    a, b = simhash_module._links_in_full(points)
    expected = simhash_module._spread(np.arange(len(points)), a, b)
    links = simhash_module.component_links(points)
    ends = np.searchsorted(points, links)
    assert (simhash_module._spread(np.arange(len(points)), ends[:, 0], ends[:, 1]) == expected).all()
    fa, fb = simhash_module._links_by_flips(points)
    assert (simhash_module._spread(np.arange(len(points)), fa, fb) == expected).all()
    tree = simhash_module.ShardTree.build(points[::3], 8)
    shards, where = tree.route(points)
    at = [set(where[shards == s].tolist()) for s in range(tree.shards)]
    assert all(any(i in s and j in s for s in at) for i, j in zip(a.tolist(), b.tolist(), strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_quality(docs, none, labels):
    model = fit_quality(docs, labels)
    assert ids(score_documents(docs, model)) == ALL
    assert all(0 <= r["score"] <= 1 for r in score_documents(docs, model).collect())
    assert score_documents(none, model).collect() == []
    assert keep_quality(docs, model).columns == docs.columns
    assert fit_quality(docs, labels.limit(0)).feature.shape[0] == 0
    assert ids(keep_quality(docs, fit_quality(docs, labels.limit(0)))) == ALL
    assert fit_quality(none, labels).score(document_statistics(["x", None, ""])).tolist() == [0.5] * 3


def test_trees_learn_and_repeat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = fit_boosted_trees(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert (fit_boosted_trees(x[:2000], y[:2000]).score(x) == model.score(x)).all()
    one_by_one = []
    for row in x[:50]:
        raw = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while 2 * node + 1 < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            raw += v[node]
        one_by_one.append(1 / (1 + np.exp(-raw)))
    assert model.score(x[:50]) == pytest.approx(one_by_one)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, none, bench, labels, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.count() > 0
    if name != "tokens":
        assert out.columns == docs.columns
    assert stage(spark, none, str(tmp_path)).collect() == []


def test_helpers(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).repartition(6)
    ranked = in_order(df, ["k", "v"]).orderBy("_rank").collect()
    assert [r["_rank"] for r in ranked] == list(range(1000))
    assert [(r["k"], r["v"]) for r in ranked] == sorted((r["k"], r["v"]) for r in ranked)
    small = spark.createDataFrame([(1, "x")], "k long, w string")
    assert join_checked(df, small, ["k"], "inner").count() == join_checked(df, small, ["k"], "inner", rows=10**9).count()
