"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptweave.session import shared_folder

BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; reading it again does no work twice."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def join_checked(
    df: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int | None = None
) -> DataFrame:
    """Broadcast ``small`` if it has at most ``BROADCAST_ROWS`` rows, else let both sides shuffle.

    ``rows`` is its number of rows where that is known; else it is counted, so
    hand in a stored table. Without the hint adaptive execution splits the rows
    of a hot key over several tasks.
    """
    if (small.count() if rows is None else rows) <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, on, how)


def in_order(df: DataFrame, keys: Sequence[str], rank: str = "_rank") -> DataFrame:
    """Rows of a narrow table with their place 0 .. n-1 in the order of ``keys``; stored.

    A sort over all executors numbers the rows of each partition; the number of
    rows in the partitions before it (one row per partition reaches the driver)
    makes that a place in the whole. Rows equal in every key are interchangeable.
    """
    placed = stored(
        df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33).cast("int"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n")).collect()
    bases, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in sizes):
        bases.append((part, total - (part << 33)))
        total += n
    base = df.sparkSession.createDataFrame(bases, "_part int, _base long")
    ranked = placed.join(F.broadcast(base), "_part")
    return ranked.withColumn(rank, F.col("_at") + F.col("_base")).select(*df.columns, rank)


def _edge_state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a sum over them that tells two edge sets apart."""
    parts = [F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(1 << 40)) for seed in (0, 1)]
    row = edges.agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)]).first()
    return row["n"], row["s0"], row["s1"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of an edge table ``(u, v)``; root is the smallest node.

    Alternates the large-star and small-star steps until no edge changes: each
    node's larger neighbours, then its smaller ones, are linked to its smallest.
    Minima are combined before the shuffle and joined back, so no task gathers
    the neighbours of a node; a node with very many of them is a skewed join,
    which adaptive execution splits. Rounds grow with the logarithm of the size.
    """
    edges = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        )
        edges = stored(small.where("u <> v").distinct())
        state = _edge_state(edges)
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.union(own)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
