from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from promptweave.operators.row_ids import with_dense_id


def numbered(df, **kwargs):
    return with_dense_id(df, "k", **kwargs).orderBy("id").collect()


@pytest.mark.parametrize("partitions", [1, 2, 7, 200])
def test_dense_and_in_key_order(spark, partitions):
    keys = random.Random(1).sample(range(-10_000, 10_000), 3000)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string").repartition(partitions)
    rows = numbered(df)
    assert [r["id"] for r in rows] == list(range(3000))
    assert [r["k"] for r in rows] == sorted(keys)
    assert all(r["v"] == f"v{r['k']}" for r in rows)


def test_ids_do_not_depend_on_partitions(spark):
    """Equal keys, a hot one among them, get the same ids however rows are dealt."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 100).alias("k"), F.col("id").alias("payload")
    )
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("2", "9", "31"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append({r["payload"]: r["id"] for r in numbered(df.repartition(int(partitions)))})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_first_rows_are_those_of_the_whole(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("k"), F.col("id").alias("payload")).repartition(4)
    whole = [tuple(r) for r in numbered(df)]
    for n in (1, 20, 499, 500, 10**6):
        assert [tuple(r) for r in numbered(df, n_rows=n)] == whole[:n]


def test_keyless_rows_keep_the_order_of_their_files(spark, tmp_path):
    texts = [f"line {i}" for i in random.Random(2).sample(range(1000), 300)]
    for i in range(3):
        (tmp_path / f"part{i}.txt").write_text("\n".join(texts[i * 100 : i * 100 + 100]))
    rows = with_dense_id(spark.read.text(str(tmp_path))).orderBy("id").collect()
    assert [r["value"] for r in rows] == texts


def test_start_and_name(spark):
    df = spark.range(5).toDF("k")
    rows = with_dense_id(df, "k", "doc_id", start=100).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["k"]) for r in rows] == [(100 + i, i) for i in range(5)]


def test_empty_table(spark):
    assert numbered(spark.range(0).toDF("k")) == []


def test_keys_beyond_the_precision_of_a_double(spark):
    base = 2**60
    df = spark.createDataFrame([(base + i,) for i in range(200)], "k long").repartition(4)
    rows = numbered(df)
    assert [r["k"] for r in rows] == [base + i for i in range(200)]
    assert [r["id"] for r in rows] == list(range(200))


def test_a_key_with_a_third_of_the_rows_is_split(spark):
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1000).cast("long").alias("k"),
        F.col("id").alias("payload"),
    )
    numbered_df = with_dense_id(df, "k")
    rows = numbered_df.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(300_000))
    keys = [r["k"] for r in rows]
    assert keys == sorted(keys)
    assert sorted(r["payload"] for r in rows) == list(range(300_000))


def test_float_keys(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, -1.25, 3.75, 0.25)], "k double")
    assert [r["k"] for r in numbered(df)] == [-1.25, 0.25, 0.5, 3.75]


def test_text_and_decimal_keys(spark):
    df = spark.createDataFrame([("b",), ("",), ("é",), ("a",)], "k string")
    assert [r["k"] for r in numbered(df)] == ["", "a", "b", "é"]
    wide = df.select(F.conv(F.hex("k"), 16, 10).cast("decimal(38,0)").alias("k")).na.fill(0)
    values = [r["k"] for r in numbered(wide.where("k IS NOT NULL"))]
    assert values == sorted(values)


def test_null_keys_are_refused(spark):
    df = spark.createDataFrame([(1,), (None,)], "k long")
    with pytest.raises(ValueError, match="NULL in 1 rows"):
        with_dense_id(df, "k")


def test_null_keys_are_refused_among_the_first_rows_too(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "k long")
    with pytest.raises(ValueError, match="NULL in 1 rows"):
        with_dense_id(df, "k", n_rows=5)
