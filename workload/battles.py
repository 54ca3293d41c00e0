"""A table of model comparisons derived from ``documents`` by arithmetic on its key.

The SQL keeps to what Spark and DuckDB read alike, so both sides of a check
start from the same rows. Prompts are whole texts, and every rule of the
cleaning chain has rows that fail it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptweave.config import LabelRules

# All listed models, the last of them padded, and two that no tier lists.
_LISTED = [model for tier in LabelRules().tiers for model in tier.models]
MODELS = (*_LISTED[:-1], f" {_LISTED[-1]}", "llama-13b", "fastchat-t5-3b")
WINNERS = ("model_a", "model_b", "tie", "tie (bothbad)", None, " model_a ", "model_b")


def _pick(number: str, values: tuple[str | None, ...]) -> str:
    quoted = ["NULL" if v is None else f"'{v}'" for v in values]
    branches = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted))
    return f"CASE {number} % {len(values)} {branches} END"


BATTLES_SQL = f"""
    SELECT doc_id AS battle_id,
           {_pick('doc_id', MODELS)} AS model_a,
           {_pick('(doc_id * 7 + 3)', MODELS)} AS model_b,
           {_pick('doc_id', WINNERS)} AS winner,
           CASE doc_id % 50
               WHEN 7 THEN NULL
               WHEN 9 THEN '    '
               WHEN 11 THEN '  ' || text || '  '
               ELSE text
           END AS user_prompt
    FROM documents
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def battles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The battles, with ``columns`` of the documents beside theirs."""
    query = BATTLES_SQL.replace("FROM documents", ", ".join(["", *columns]) + " FROM {documents}")
    return spark.sql(query, documents=read_table(spark, sf_dir, "documents"))
