"""Registered queries against SQL where there is some, else against brute force."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from promptweave.llm.common import read_table
from promptweave.llm.oracles import ORACLES
from promptweave.llm.queries import QUERIES, TOKENIZER
from tests.conftest import SMALL
from tests.llm import brute
from tools.compare import _sorted, duck


def rows_of(spark, table, *columns):
    return [tuple(r) for r in read_table(spark, SMALL, table).select(*columns).collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return rows_of(spark, "documents", "doc_id", "text")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), duck(SMALL).execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    ours, theirs = _sorted(ours), _sorted(theirs)
    assert len(ours) == len(theirs)
    for c in ours.columns:
        assert ((ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna())).all(), c


def test_order_minhash(spark, documents):
    found = {r["doc_id"]: r for r in QUERIES["op2_order_minhash"](spark, SMALL).collect()}
    edited = brute.edited_texts(documents)
    assert set(found) == set(edited)
    for d, t in documents:
        assert found[d]["n_chars"] == len(t)
        assert found[d]["edited_sha256"] == hashlib.sha256(edited[d].encode()).hexdigest()
        assert 0 <= found[d]["near_edited"] <= 1 and 0 <= found[d]["near_next"] <= 1
    texts = dict(documents)
    by_print = {}
    for d, r in found.items():
        by_print.setdefault(texts[d], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_print.values())
    assert np.mean([r["near_edited"] for r in found.values()]) > np.mean([r["near_next"] for r in found.values()])


def test_pii(spark, documents):
    found = {r["doc_id"]: r for r in QUERIES["op4_pii"](spark, SMALL).collect()}
    assert len(found) == len(documents)
    for d, t in documents:
        spans = brute.base_spans(t)
        names = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert found[d]["base_sha256"] == hashlib.sha256(names.encode()).hexdigest()
        for kind in brute.PATTERNS:
            assert found[d][f"n_{kind}"] == sum(k == kind for k, _, _ in spans)
        listed = [s for s in found[d]["spans"].split(",") if s and not s.startswith("term")]
        assert ",".join(listed) == names


def test_repeats(spark, documents):
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op5_repeats"](spark, SMALL).collect()}
    expected = brute.removed_repeats(documents)
    assert found == {d: e for (d, _), e in zip(documents, expected, strict=True)}
    assert any(0 < e[1] < e[0] for e in expected)


def test_tokens(spark, documents):
    found = sorted(tuple(r) for r in QUERIES["op6_token_files"](spark, SMALL).collect())
    assert found == brute.token_rows(documents, Tokenizer.from_file(TOKENIZER))


def test_warc(spark):
    pages = rows_of(spark, "pages", "page_id", "html")
    found = {r["page_id"]: tuple(r)[1:5] for r in QUERIES["op3_warc"](spark, SMALL).collect()}
    assert found == brute.warc_rows(pages)


def test_main_text(spark):
    pages = {p: h for p, h in rows_of(spark, "pages", "page_id", "html")}
    found = {r["page_id"]: r for r in QUERIES["op7_main_text"](spark, SMALL).collect()}
    assert set(found) == set(pages)
    for page, row in found.items():
        assert row["text"] == brute.article(pages[page])
        assert row["n_chars"] == len(row["text"])


def test_simhash(spark, documents):
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash"](spark, SMALL).collect()}
    assert found == brute.components(documents)


def test_quality(spark):
    found = {r["doc_id"]: r for r in QUERIES["op10_quality"](spark, SMALL).collect()}
    labels = dict(rows_of(spark, "labels", "doc_id", "quality"))
    assert len(found) == len(rows_of(spark, "documents", "doc_id"))
    for d, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert r["predicted"] == (r["score"] >= 0.7)
    held = [d for d in labels if d in found and found[d]["held_out"]]
    assert np.mean([found[d]["predicted"] == labels[d] for d in held]) > 0.9


def test_pipeline(spark):
    """Each stage against a plain version that is given the stage's own input."""
    docs = read_table(spark, SMALL, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        columns = docs.columns
        docs = stage(spark, docs, SMALL)
        if name != "tokens":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            kept[name] = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if name == "near_duplicates":
            expected = brute.components(before)
            assert sorted(d for d, _ in kept[name]) == sorted(d for d, (_, c) in expected.items() if d == c)
        if name == "decontamination":
            dirty = {r["doc_id"] for r in QUERIES["op8_decontaminate"](spark, SMALL).collect() if r["contaminated"]}
            assert sorted(kept[name]) == sorted(r for r in before if r[0] not in dirty)
        if name == "mixing":
            assert {r for r in kept[name]} <= set(before)
        if name == "tokens":
            found = sorted(docs.collect(), key=lambda r: r["start"])
            wanted = brute.token_rows(before, Tokenizer.from_file(TOKENIZER))
            assert sorted((r[0], r[2], r[3]) for r in found) == sorted((r[0], r[2], r[3]) for r in wanted)
            assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1]]
            ids = [r["doc_id"] for r in found]
            assert ids != sorted(ids)
            beside = sum(a == b for a, b in zip(ids, ids[1:]))
            assert beside < 0.1 * (len(ids) - len(set(ids))) + 3
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality"
