"""The eight text features of a prompt, and the feature table's shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptweave.config import TIER_COL
from promptweave.functions.text import TEXT_FEATURES, Parts, text_or_empty


def with_text_features(
    df: DataFrame, text_col: str = "user_prompt", names: tuple[str, ...] = tuple(TEXT_FEATURES)
) -> DataFrame:
    """Add the named features, row by row; NULL text counts as empty."""
    staged, parts = Parts.staged(df, text_or_empty(text_col))
    features = [TEXT_FEATURES[name](parts).alias(name) for name in names]
    return staged.select(*[F.col(f"`{c}`") for c in df.columns], *features)


def assemble(scored: DataFrame, vector_col: str = "tfidf", keep: tuple[str, ...] = ()) -> DataFrame:
    """Features, vector and label of each row; they are of one row, so nothing is joined."""
    return scored.select(*keep, *[F.col(c) for c in TEXT_FEATURES], vector_col, TIER_COL)
