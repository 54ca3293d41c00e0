from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from promptweave.operators.reduction import fit_clusters, fit_term_space, with_cluster
from promptweave.operators.tfidf import fit_tfidf
from tests.conftest import SMALL


def vectors(spark, dense, parts=4):
    rows = [(i, Vectors.sparse(len(r), [(int(j), float(r[j])) for j in np.flatnonzero(r)]) if i % 2 else Vectors.dense(r)) for i, r in enumerate(dense)]
    return spark.createDataFrame(rows, ["id", "tfidf"]).repartition(parts)


def test_equals_dense_svd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) @ np.diag([9, 7, 5, 3, 2, 1]) @ rng.normal(size=(6, 40))
    x[rng.random(x.shape) < 0.5] = 0
    x[:3] = 0
    df = vectors(spark, x)
    space = fit_term_space(df, "tfidf", 40, 4, passes=12)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(space.singular, s[:4], rtol=1e-6)
    assert np.allclose(np.abs(space.directions.T @ vt[:4].T), np.eye(4), atol=1e-3)
    assert np.allclose(space.shares, s[:4] ** 2 / (x**2).sum())
    reduced = {r["id"]: r["reduced"] for r in space.project(df, "tfidf").collect()}
    assert np.allclose([reduced[i] for i in range(300)], x @ space.directions)


def test_documents(spark):
    """The share explained is that of an exact decomposition."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = fit_tfidf(docs, "text", max_features=200)
    scored = model.transform(docs).select("doc_id", "tfidf").checkpoint()
    space = fit_term_space(scored, "tfidf", 200, 10)
    dense = np.array([r["tfidf"].toArray() for r in scored.collect()])
    s = np.linalg.svd(dense, compute_uv=False)[:10]
    assert space.shares.sum() == pytest.approx((s**2).sum() / (dense**2).sum(), rel=1e-3)
    reduced = space.project(scored, "tfidf")
    model = fit_clusters(reduced, 4)
    found = with_cluster(reduced, model)
    assert found.columns == ["doc_id", "tfidf", "reduced", "cluster"] and found.count() == len(dense)
    assert 1 < found.select("cluster").distinct().count() <= 4


def test_fewer_rows_than_dimensions(spark):
    space = fit_term_space(vectors(spark, np.array([[1.0, 0, 2], [0, 0, 0]])), "tfidf", 3, 5)
    assert len(space.singular) == 3 and space.singular[0] == pytest.approx(5**0.5)
    assert np.allclose(space.singular[1:], 0, atol=1e-6) and space.shares[0] == pytest.approx(1)
    with pytest.raises(ValueError, match="non-zero"):
        fit_term_space(vectors(spark, np.zeros((2, 3))), "tfidf", 3, 2)
