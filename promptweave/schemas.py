"""Explicit schemas of the tables the jobs exchange, and the column contract."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("role", T.StringType()),
    ]
)

BATTLES = T.StructType(
    [
        T.StructField("battle_id", T.LongType()),
        T.StructField("model_a", T.StringType()),
        T.StructField("model_b", T.StringType()),
        T.StructField("winner", T.StringType()),
        T.StructField("conversation_a", T.ArrayType(MESSAGE)),
    ]
)

# The same battles after collection: nesting is text once it has been through CSV.
RAW_BATTLES_CSV = T.StructType(
    [
        T.StructField("battle_id", T.LongType()),
        T.StructField("model_a", T.StringType()),
        T.StructField("model_b", T.StringType()),
        T.StructField("winner", T.StringType()),
        T.StructField("user_prompt", T.StringType()),
    ]
)

LABELED = T.StructType(
    [
        T.StructField("user_prompt", T.StringType()),
        T.StructField("Target_Tier", T.StringType()),
    ]
)

HISTORICAL_PROMPTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("user_prompt", T.StringType()),
        T.StructField("Target_Tier", T.StringType()),
    ]
)

PROMPT_DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("user_prompt", T.StringType()),
        T.StructField("Target_Tier", T.StringType()),
    ]
)


def require_columns(df: DataFrame, required: Iterable[str], source: str = "input") -> DataFrame:
    """Return ``df`` unchanged, or raise before any job runs if columns are absent."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{source} lacks columns {missing}; it has {df.columns}")
    return df
