"""Score arriving prompt files with a fitted model.

Features and the fitted TF-IDF pipeline look at one row at a time, so the batch
functions run unchanged on a stream and keep no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from promptweave.operators.tfidf import TfidfModel
from promptweave.plans.jobs import featurise
from promptweave.schemas import HISTORICAL_PROMPTS


def prompt_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(HISTORICAL_PROMPTS)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(
    prompts: DataFrame, model: TfidfModel, out: str, checkpoint: str
) -> StreamingQuery:
    """Append the features of new prompts to ``out`` and stop when none are left.

    ``checkpoint`` records what has been scored; a restart goes on from there.
    """
    return (
        featurise(prompts, model)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
