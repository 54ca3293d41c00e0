"""Counts, shares and balance of labelled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptweave.config import TIER_COL, WINNING_MODEL_COL
from promptweave.functions.text import percent_bar

IMBALANCE_ALARM = 1.5


def _counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, largest first; NULL is not a value, ties go by value."""
    return _counts(df, col).orderBy(F.desc("count"), col)


def model_coverage(labeled: DataFrame) -> DataFrame:
    """Wins per (winning model, tier), largest first."""
    keys = (WINNING_MODEL_COL, TIER_COL)
    return labeled.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *keys)


def tier_shares(df: DataFrame, tier_col: str = TIER_COL) -> DataFrame:
    """Count and percent per tier.

    For columns of labels: the window without keys runs in one task over the
    grouped rows, one per label. A column of very many values belongs in
    ``value_counts``, which sorts them on all executors.
    """
    counts = _counts(df, tier_col)
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(tier_col, "count", (F.col("count") * F.lit(100.0) / total).alias("pct"))


def tier_report(df: DataFrame, tier_col: str = TIER_COL) -> DataFrame:
    """Tier shares with a bar of 50 cells, largest tier first."""
    shares = tier_shares(df, tier_col)
    return shares.withColumn("bar", percent_bar("pct")).orderBy(F.desc("count"), tier_col)


def imbalance(
    df: DataFrame, tier_col: str = TIER_COL, alarm: float = IMBALANCE_ALARM
) -> DataFrame:
    """Largest over smallest tier; no rows give a NULL ratio and no flag."""
    ratio = F.max("count").cast("double") / F.min("count")
    flagged = F.coalesce(F.col("ratio") > alarm, F.lit(False))
    return _counts(df, tier_col).agg(ratio.alias("ratio")).withColumn("imbalanced", flagged)
