"""Reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptweave.config import TIER_COL
from promptweave.functions.text import SEMANTIC_FEATURES, STATISTICAL_FEATURES


def feature_report(
    features: DataFrame, n_terms: int, tier_col: str = TIER_COL
) -> DataFrame:
    """``(metric, value, pct)``: rows, sizes of the feature groups, rows per tier.

    Both halves start from one grouping by tier, whose exchange Spark reuses.
    Percents are of all rows, those without a tier included.
    """
    per_tier = features.groupBy(tier_col).agg(F.count("*").alias("n"))
    hand_made = len(STATISTICAL_FEATURES) + len(SEMANTIC_FEATURES)
    sizes = {
        "input_rows": F.coalesce(F.sum("n"), F.lit(0)),
        "statistical_features": F.lit(len(STATISTICAL_FEATURES)),
        "semantic_features": F.lit(len(SEMANTIC_FEATURES)),
        "tfidf_features": F.lit(n_terms),
        "total_feature_columns": F.lit(hand_made + n_terms),
    }
    totals = per_tier.agg(*[size.cast("long").alias(name) for name, size in sizes.items()])
    fixed = totals.unpivot([], list(sizes), "metric", "value")

    # One row per tier is left by now, so the window over all of them is small.
    share = F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy())
    tiers = per_tier.select(tier_col, "n", share.alias("pct")).where(F.col(tier_col).isNotNull())
    return fixed.withColumn("pct", F.lit(None).cast("double")).unionByName(
        tiers.select(
            F.concat(F.lit("tier:"), F.col(tier_col)).alias("metric"), F.col("n").alias("value"), "pct"
        )
    )
