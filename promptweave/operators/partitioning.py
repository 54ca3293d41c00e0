"""Spread an input over the cores before row-wise text work, where the caller asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame

INPUT_TASKS = "spark.promptweave.inputTasks"


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deal rows to ``tasks`` partitions; as they are scanned if neither it nor the setting is given.

    A Parquet file is read by one task per row group, so a small table may keep
    one core busy while text functions do the real work. On a large one this
    would shuffle every text for nothing, so it is never done unasked: give
    ``tasks``, or set ``spark.promptweave.inputTasks`` for a session over small
    files.
    """
    setting = df.sparkSession.conf.get(INPUT_TASKS, None)
    tasks = tasks or (int(setting) if setting else None)
    return df if tasks is None or df.isStreaming else df.repartition(tasks)
