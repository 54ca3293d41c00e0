"""TF-IDF against a brute-force count in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptweave.functions.constants import ENGLISH_STOP_WORDS
from promptweave.operators import tfidf
from promptweave.operators.tfidf import TfidfModel, fit_tfidf, long_form, sparsity, widen


def terms_of(text: str | None) -> list[str]:
    words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in ENGLISH_STOP_WORDS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(texts, max_features):
    counted = [Counter(terms_of(t)) for t in texts]
    tf, df = Counter(), Counter()
    for c in counted:
        tf.update(c)
        df.update(c.keys())
    cut = sorted(tf, key=lambda t: (-tf[t], t))[:max_features]
    vocabulary = [(t, tf[t], df[t]) for t in sorted(cut)]
    idf = {t: math.log((1 + len(texts)) / (1 + d)) + 1 for t, _, d in vocabulary}
    rows = []
    for c in counted:
        weights = {t: c[t] * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        rows.append({t: w / norm for t, w in weights.items()})
    return vocabulary, rows


def corpus(n: int, words: int, seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    common = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(rng.choices(names, common, k=rng.randrange(0, 30))) for _ in range(n)]
    return texts + [None, "", "the and", "New York, new york", "été Été"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, user_prompt string").repartition(4)


@pytest.mark.parametrize("max_features", [1, 5, 40, 100_000])
@pytest.mark.parametrize("words", [6, 60])
def test_vocabulary_and_weights(spark, max_features, words):
    texts = corpus(150, words)
    vocabulary, rows = brute_force(texts, max_features)
    df = frame(spark, texts)
    model = fit_tfidf(df, max_features=max_features)
    assert model.n_docs == len(texts)
    assert [(t.term, t.tf, t.df) for t in model.vocabulary] == vocabulary
    got = [{} for _ in texts]
    for r in long_form(model.transform(df), model, "id").collect():
        got[r["id"]][r["term"]] = r["weight"]
    for mine, wanted in zip(got, rows, strict=True):
        assert mine == pytest.approx(wanted, abs=1e-12)


def test_long_ties_at_the_cut_count_all_pairs(spark):
    """More words share the last place than are listed, so no pair may be left out."""
    texts = [f"a{i:03d} b{i:03d}" for i in range(300)]
    vocabulary, _ = brute_force(texts, 3)
    model = fit_tfidf(frame(spark, texts), max_features=3)
    assert [(t.term, t.tf, t.df) for t in model.vocabulary] == vocabulary
    assert "a000 b000" in model.terms


def test_a_bigram_wins_a_tie_against_a_word(spark):
    texts = ["alpha beta"] * 5 + ["zeta"] * 5 + ["gamma"]
    model = fit_tfidf(frame(spark, texts), max_features=3)
    assert model.terms == ["alpha", "alpha beta", "beta"]


def test_only_terms_that_start_with_top_words_are_counted(spark, monkeypatch):
    texts = corpus(150, 60)
    seen = []
    real = tfidf.counted_terms
    monkeypatch.setattr(tfidf, "counted_terms", lambda d, t, f: seen.append(f) or real(d, t, f))
    fit_tfidf(frame(spark, texts), max_features=10)
    counts = Counter(w for t in texts for w in terms_of(t) if " " not in w)
    top = sorted(counts, key=lambda w: (-counts[w], w))[:10]
    assert sorted(seen[0]) == sorted(top)


def test_listed_and_joined_words_give_the_same_terms(spark, monkeypatch):
    df = frame(spark, corpus(150, 60))
    listed = fit_tfidf(df, max_features=15).vocabulary
    monkeypatch.setattr(tfidf, "NAMED_WORDS", 0)
    assert fit_tfidf(df, max_features=15).vocabulary == listed


def test_cells_of_dense_and_empty_vectors(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(0, Vectors.dense([0.0, 2.0])), (1, Vectors.sparse(3, {2: 4.0})), (2, Vectors.sparse(3, {}))]
    df = spark.createDataFrame(rows, ["id", "v"])
    cells = df.select("id", F.inline(tfidf.stored_cells("v"))).where("weight != 0").collect()
    assert sorted(tuple(r) for r in cells) == [(0, 1, 2.0), (1, 2, 4.0)]


def test_vectors_have_norm_one_or_zero(spark):
    df = frame(spark, corpus(100, 30))
    model = fit_tfidf(df, max_features=20)
    cells = tfidf.vector_to_array("tfidf")
    norms = model.transform(df).select(
        F.sqrt(F.aggregate(cells, F.lit(0.0), lambda a, w: a + w * w)).alias("n")
    )
    values = {round(r["n"], 9) for r in norms.collect()}
    assert values == {0.0, 1.0}


def test_sparsity_counted_and_fitted_agree(spark):
    df = frame(spark, corpus(100, 30))
    model = fit_tfidf(df, max_features=25)
    row = sparsity(model.transform(df), "tfidf", len(model.terms)).first()
    assert row["rows"] == 105
    assert row["sparsity"] == pytest.approx(model.fit_sparsity())
    none = sparsity(model.transform(df.limit(0)), "tfidf", 25).first()
    assert none["sparsity"] is None


def test_saved_model_scores_alike(spark, tmp_path):
    df = frame(spark, corpus(80, 30))
    model = fit_tfidf(df, max_features=25)
    path = str(tmp_path / "model")
    model.save(spark, path)
    model.save(spark, path)
    loaded = TfidfModel.load(spark, path)
    assert loaded.vocabulary == model.vocabulary
    assert loaded.n_docs == model.n_docs
    assert loaded.transform(df).orderBy("id").collect() == model.transform(df).orderBy("id").collect()


def test_scoring_adds_just_the_vector(spark):
    df = frame(spark, ["red apple", "green apple"])
    model = fit_tfidf(df)
    assert model.transform(df).columns == ["id", "user_prompt", "tfidf"]


def test_unseen_terms_are_ignored(spark):
    model = fit_tfidf(frame(spark, ["red apple", "green apple"]))
    row = model.transform(frame(spark, ["blue pear"])).first()
    assert row["tfidf"].numNonzeros() == 0


def test_wide_columns(spark):
    df = frame(spark, ["red apple", "green apple"])
    model = fit_tfidf(df)
    wide = widen(model.transform(df), model)
    assert wide.columns == ["id", "user_prompt", *[f"tfidf_{t}" for t in model.terms]]
    vectors = {r["id"]: list(r["tfidf"].toArray()) for r in model.transform(df).collect()}
    for row in wide.collect():
        assert list(row[2:]) == vectors[row["id"]]


def test_other_stop_words(spark):
    model = fit_tfidf(frame(spark, ["the red apple"]), stop_words=("red",))
    assert model.terms == ["apple", "the", "the apple"]


def test_nothing_to_fit(spark):
    with pytest.raises(ValueError, match="no terms"):
        fit_tfidf(frame(spark, ["the", None]))
    with pytest.raises(ValueError, match="no terms"):
        fit_tfidf(frame(spark, ["x"]).limit(0))


def test_vocabulary_table(spark):
    model = fit_tfidf(frame(spark, ["red apple", "green apple"]))
    table = model.vocabulary_table(spark).orderBy("idx").collect()
    assert [r["term"] for r in table] == sorted(r["term"] for r in table)
    assert [r["idx"] for r in table] == list(range(len(table)))
    apple = next(r for r in table if r["term"] == "apple")
    assert (apple["tf"], apple["df"], apple["idf"]) == (2, 2, 1.0)


def counted_in_blocks(texts, pairs, first=None, second=None):
    words = [[w for w in terms_of(t) if " " not in w] for t in texts]
    arrays = [pa.array(w, pa.string()) if w is not None else None for w in (first, second)]
    tf, df, sizes = Counter(), Counter(), []
    for block in tfidf._blocks(pa.array(words, pa.list_(pa.string()))):
        sizes.append(len(block.flatten()))
        for batch in tfidf._block_counts(block, pairs, *arrays):
            for r in batch.to_pylist():
                tf[r["term"]] += r["tf"]
                df[r["term"]] += r["df"]
    return tf, df, sizes


@pytest.mark.parametrize("size", [1, 9, 1 << 20])
def test_counts_of_blocks_add_up(monkeypatch, size):
    texts = corpus(150, 12)
    monkeypatch.setattr(tfidf, "BLOCK_WORDS", size)
    tf, df, sizes = counted_in_blocks(texts, True)
    counted = [Counter(terms_of(t)) for t in texts]
    assert tf == sum(counted, Counter())
    assert df == sum((Counter(c.keys()) for c in counted), Counter())
    assert (len(sizes) > 1) == (size < 1 << 20)
    some, _, _ = counted_in_blocks(texts, True, ["w1", "w2"], ["w3"])
    assert some == {t: n for t, n in tf.items() if t.split()[0] in ("w1", "w2") and t.split()[1:] in ([], ["w3"])}


def test_pairs_end_with_words_that_are_as_frequent(spark, monkeypatch):
    """A rare word after a frequent one makes no pair that the second pass has to count."""
    texts = ["alpha beta"] * 4 + ["gamma delta"] * 3 + [f"alpha rare{i}" for i in range(30)] + ["beta delta"]
    seen = []
    real = tfidf.counted_terms
    monkeypatch.setattr(tfidf, "counted_terms", lambda d, t, f: seen.append(real(d, t, f)) or seen[-1])
    model = fit_tfidf(frame(spark, texts), max_features=4)
    assert {r["term"] for r in seen[0].collect()} == {"alpha", "beta", "delta", "gamma", "alpha beta", "gamma delta", "beta delta"}
    assert [(t.term, t.tf, t.df) for t in model.vocabulary] == brute_force(texts, 4)[0]
