"""Label battles as they arrive and store them exactly once, with a running audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from promptweave.config import LabelRules
from promptweave.operators.labeling import labeled_prompts, watched
from promptweave.session import scratch_path
from promptweave.sources.prompt_store import PromptStore


def battle_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Battle files as they are landed, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def label_stream(
    battles: DataFrame,
    store: PromptStore,
    checkpoint: str,
    rules: LabelRules = LabelRules(),
    key: str = "battle_id",
    name: str = "stream",
) -> StreamingQuery:
    """Label all that has arrived, one load per batch, and stop.

    A batch is read once, labelled into a staging folder. Its audit is counted on the way
    and goes into the ledger with its load, so ``store.audit()`` is the audit of all batches so far. A batch that is run
    again after a crash has the same number and hence the same load, which the ledger
    counts once. ``name`` tells streams that feed one store apart; it belongs to
    ``checkpoint``, which a restart needs: with a new one choose a new name.
    """

    def store_batch(batch: DataFrame, number: int) -> None:
        seen, counts = watched(batch, rules)
        staged = scratch_path(batch.sparkSession, "labeled")
        labeled_prompts(seen, rules, keep=(key,)).write.parquet(staged)
        labeled = batch.sparkSession.read.parquet(staged)
        store.load(labeled, key, f"{name}-{number}", counts.get)

    return (
        battles.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
