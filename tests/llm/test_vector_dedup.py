"""Near-duplicate vectors against all pairs, and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from promptweave.llm.common import read_table
from promptweave.llm.vector_dedup import bucket_codes, hadamard, tables_for, vector_components
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cell string, code int"


def usable(vector, label):
    if label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
        return None
    x = np.asarray(vector, np.float32).astype(float)
    return x / np.linalg.norm(x) if x.any() else None


def brute(rows):
    units = [usable(v, label) for _, v, label, *_ in rows]
    near = [
        [j for j, b in enumerate(units) if i != j and a is not None and b is not None and len(a) == len(b)
         and rows[i][2] == rows[j][2] and a @ b >= 0.93]
        for i, a in enumerate(units)
    ]
    out = []
    for i, links in enumerate(near):
        reached, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in reached]
            reached.update(new)
            todo += new
        low = min((rows[j][0] for j in reached if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links), low, rows[i][0] is not None and rows[i][0] == low))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vector_components(df).collect()), key=str)


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(hadamard(hadamard(x)) / 16, x)
    codes = bucket_codes(np.eye(64), 0, 2)
    assert codes.shape == (64, 5) and len({tuple(c) for c in codes}) == 64
    assert all(len(set(c)) == 5 for c in codes)
    assert 1 < tables_for(64, 2) < tables_for(64, 3)


def test_edges(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, nan], 1), (6, [1.0, None], 1),
        (7, [inf, 1.0], 1), (8, [1.0, 0.0], None), (8, [2.0, 0.0], 1), (8, [2.0, 0.0], 1), (None, [3.0, 0.01], 1),
        (None, [0.0, 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [-1.0, 0.0], 1), (11, [1e-30, 0.0], 1), (12, [1e30, 0.0], 1),
        (13, [], 1), (14, [1.0], 1), (15, [2.0], 1), (16, [-2.0], 1), (17, [1.0, 0.0], 2),
    ]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("spread", [0.05, 0.2, 0.28, 0.34])
def test_groups_of_copies(spark, spread):
    """Groups from tight to as wide as the threshold, among unlike vectors."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=48), i % 2) for i in range(200)]
    for g in range(3):
        center, noise = rng.normal(size=48), rng.normal(size=(120, 48))
        center /= np.linalg.norm(center)
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        rows += [(1000 * (g + 1) + i, center + spread * n, 1) for i, n in enumerate(noise)]
    rows = [(i, [float(x) for x in v], label) for i, v, label in rows]
    ours, wanted = found(spark, rows), brute(rows)
    links = sum(w[1] for w in wanted)
    assert sum(r[1] for r in ours) >= 0.99 * links
    assert all(r[0] == w[0] and r[1] <= w[1] for r, w in zip(sorted(ours), sorted(wanted), strict=True))
    if spread < 0.3:
        assert ours == wanted


def test_nothing_fits(spark):
    assert found(spark, []) == []
    assert found(spark, [(3, None, 1), (None, [1.0], None)]) == [(3, 0, 3, True), (None, 0, None, False)]


def test_given_table(spark):
    df = read_table(spark, SMALL, "embeddings")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in vector_components(df).collect()), key=str) == brute(rows)
