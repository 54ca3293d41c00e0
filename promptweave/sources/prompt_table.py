"""The stored prompt table: load with dense ids, fetch by tier, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptweave.operators.row_ids import numbered

PROMPT_TABLE = "historical_prompts"


def save_prompts(
    labeled: DataFrame,
    key: str | None,
    table: str = PROMPT_TABLE,
    mode: str = "overwrite",
    path: str | None = None,
) -> int:
    """Store ``(id, user_prompt, Target_Tier)`` and return the number of rows loaded.

    Ids are dense in the order of ``key``, of the files read if it is None. An
    append goes on after the largest stored id, so ids stay unique. The table
    is partitioned by tier, which lets a fetch of one tier skip the files of
    the others. The input may be derived: it is computed once, and the number
    of rows is known from giving ids.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be 'overwrite' or 'append', not {mode!r}")
    spark = labeled.sparkSession
    start = 0
    if mode == "append" and spark.catalog.tableExists(table):
        largest = spark.table(table).agg(F.max("id")).first()[0]
        start = 0 if largest is None else largest + 1
    columns = dict.fromkeys([*([key] if key else []), "user_prompt", "Target_Tier"])
    rows, n = numbered(labeled.select(*columns), key, "__id", start)
    writer = (
        rows.select(F.col("__id").alias("id"), "user_prompt", "Target_Tier")
        .write.mode(mode)
        .format("parquet")
        .partitionBy("Target_Tier")
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return n


def read_prompts(spark: SparkSession, table: str = PROMPT_TABLE) -> DataFrame:
    """Every stored row, those without a prompt included."""
    if not spark.catalog.tableExists(table):
        raise FileNotFoundError(f"table {table} does not exist: run the store job first")
    return spark.table(table).select("id", "user_prompt", "Target_Tier")


def _with_prompt(spark: SparkSession, table: str) -> DataFrame:
    return read_prompts(spark, table).where(F.col("user_prompt").isNotNull())


def fetch_prompts(
    spark: SparkSession, tier: str | None = None, table: str = PROMPT_TABLE
) -> DataFrame:
    """Stored prompts in id order, of one tier if given; rows without prompt are left out."""
    rows = _with_prompt(spark, table)
    if tier is not None:
        rows = rows.where(F.col("Target_Tier") == F.lit(tier))
    return rows.orderBy("id")


def summarise(prompts: DataFrame) -> DataFrame:
    """Prompts and percent per tier, largest first; the window sees one row per tier."""
    counts = prompts.groupBy("Target_Tier").agg(F.count("*").alias("prompt_count"))
    share = F.col("prompt_count") * F.lit(100.0) / F.sum("prompt_count").over(Window.partitionBy())
    return counts.withColumn("pct", F.round(share, 2)).orderBy(
        F.desc("prompt_count"), "Target_Tier"
    )


def prompt_summary(spark: SparkSession, table: str = PROMPT_TABLE) -> DataFrame:
    """Stored prompts and percent per tier, largest first."""
    return summarise(_with_prompt(spark, table))
