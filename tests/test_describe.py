from __future__ import annotations

import math
import random

import pandas as pd
import pytest

from promptweave.operators import describe as module
from promptweave.operators.describe import describe
from tests.conftest import SMALL


def check(spark, columns: dict[str, list], digits=None):
    frame = pd.DataFrame(columns)
    schema = ", ".join(f"{c} double" for c in columns)
    rows = list(zip(*columns.values()))
    got = describe(spark.createDataFrame(rows, schema).repartition(6), list(columns), digits)
    wanted = frame.describe()
    names = {"25%": "p25", "50%": "p50", "75%": "p75"}
    for row in got.collect():
        for stat, value in wanted[row["feature"]].items():
            mine = row[names.get(stat, stat)]
            if math.isnan(value):
                assert mine is None, stat
            else:
                assert mine == pytest.approx(value, rel=1e-12, abs=1e-12), (row["feature"], stat)


def test_two_scans(spark, monkeypatch):
    """The sketch and one count of cells, over more values than are counted one by one."""
    scans, counted = [], module._counted
    monkeypatch.setattr(module, "VALUES", 1000)
    monkeypatch.setattr(module, "_counted", lambda df, b: scans.append(b) or counted(df, b))
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    found = describe(lines, columns, None, materialise=False).collect()
    assert len(scans) == 1
    wanted = lines.select(*columns).toPandas().astype(float).describe()
    for row in found:
        for name, stat in (("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("mean", "mean"), ("std", "std")):
            assert row[name] == pytest.approx(wanted[row["feature"]][stat], rel=1e-12)


@pytest.mark.parametrize("error", [0.002, 0.0])
def test_many_shapes_by_bins(spark, monkeypatch, error):
    """Brackets too large to count by value, and brackets that miss their ranks."""
    monkeypatch.setattr(module, "VALUES", 4)
    monkeypatch.setattr(module, "RANK_ERROR", error)
    monkeypatch.setattr(module, "SKETCH_SIZE", 16)
    test_many_shapes(spark)
    test_infinities_and_full_range(spark)


def test_many_shapes(spark):
    rng = random.Random(3)
    n = 2501
    check(
        spark,
        {
            "uniform": [rng.random() for _ in range(n)],
            "whole": [float(rng.randrange(5)) for _ in range(n)],
            "one_third_zero": [0.0 if i % 3 else rng.gauss(0, 1e6) for i in range(n)],
            "constant": [4.5] * n,
            "powers": [10.0 ** rng.randrange(-100, 100) for _ in range(n)],
            "neighbours": [1.0 + rng.randrange(8) * 2**-52 for _ in range(n)],
            "negative": [-rng.expovariate(1e-3) for _ in range(n)],
        },
    )


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [3.0, 3.0, 9.0]])
def test_few_rows(spark, values):
    check(spark, {"x": values})


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame(
        [(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "x double, y double"
    )
    x, y = describe(df, ["x", "y"]).collect()
    assert (x["count"], x["mean"], x["p50"], x["max"]) == (2, 2.0, 2.0, 3.0)
    assert (y["count"], y["mean"], y["p50"]) == (0, None, None)


def test_rounds_half_to_even(spark):
    df = spark.createDataFrame([(2.125,)], "x double")
    row = describe(df, ["x"], materialise=False).first()
    assert (row["min"], row["std"]) == (2.12, None)


def test_infinities_and_full_range(spark):
    inf = float("inf")
    top = 1.7e308
    rows = [(inf, -top), (-inf, top), (1.0, 0.0), (2.0, 5.0), (inf, -1.0)]
    x, y = describe(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], None).collect()
    assert (x["min"], x["p25"], x["p50"], x["p75"], x["max"]) == (-inf, 1.0, 2.0, inf, inf)
    assert (y["min"], y["p25"], y["p50"], y["p75"], y["max"]) == (-top, -1.0, 0.0, 5.0, top)
    (z,) = describe(spark.createDataFrame([(inf,), (inf,)], "z double"), ["z"], None).collect()
    assert (z["p25"], z["p75"]) == (inf, inf)
