"""Dense row numbers in key order, without sorting everything in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweave.session import scratch_path

TOP_ROWS = 10_000

_KEY = "__key"
_TIE = "__tie"
_PLACE = "__place"
_BASE = "__base"
_PART = "__part"


def _is_file_scan(df: DataFrame) -> bool:
    """Whether rows come from files by nothing but filters and projections, as file names need."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return plan.nodeName().startswith("LogicalRelation") or "Relation [" in plan.toString().splitlines()[0]


def with_dense_id(
    df: DataFrame,
    key: str | None = None,
    id_col: str = "id",
    start: int = 0,
    n_rows: int | None = None,
) -> DataFrame:
    """The rows of ``numbered``, which says how ids are given."""
    return numbered(df, key, id_col, start, n_rows)[0]


def numbered(
    df: DataFrame,
    key: str | None = None,
    id_col: str = "id",
    start: int = 0,
    n_rows: int | None = None,
) -> tuple[DataFrame, int]:
    """The rows with ids, and how many they are, which is known from giving the ids.

    Adds ``start .. start+n-1`` in the order of a non-null row key of any type that sorts.

    1. All executors sort the rows by key and, for equal keys, by a hash of the
       row, so a key of very many rows is spread over several tasks and the
       order does not depend on how the rows are partitioned. The sorted rows
       are written once to the shared folder with their place in their
       partition; whatever ``df`` is derived from is not computed again.
    2. Rows per partition are counted (one row each) and summed up to the first
       id of each partition, which is added to the place.

    Without a key, rows keep the order of the files they come from, by file name
    and position; a ``df`` that is no plain scan of files is an error. ``n_rows`` keeps
    the first ids only; more than ``TOP_ROWS`` are numbered with all others and cut
    off then, so that no task has to gather them.
    A NULL key is an error, as its place would mean nothing. Spark samples the keys of
    ``df`` to set the bounds of the sort, which reads a derived ``df`` once more.
    """
    spark = df.sparkSession
    if key is None and not _is_file_scan(df):
        raise ValueError("rows without a key have an order only as read from files; name a key")
    order: list[Column]
    if key is None:
        placed = df.withColumns({_KEY: F.input_file_name(), _TIE: F.monotonically_increasing_id()})
    else:
        placed = df.withColumns({_KEY: F.col(key), _TIE: F.xxhash64(*[F.col(c) for c in df.columns])})
    order = [F.col(_KEY), F.col(_TIE)]
    ordered = placed.orderBy(*order)
    if n_rows is not None and n_rows <= TOP_ROWS:
        ordered = ordered.limit(n_rows)
    ordered = ordered.withColumn(_PLACE, F.monotonically_increasing_id())
    staged_path = scratch_path(spark, "ordered")
    ordered.withColumn(_TIE, F.col(_KEY).isNull()).drop(_KEY).write.parquet(staged_path)
    staged = spark.read.parquet(staged_path).withColumn(_PART, F.shiftright(_PLACE, 33).cast("int"))
    counted = staged.groupBy(_PART).agg(F.count("*").alias("n"), F.count_if(_TIE).alias("nulls")).collect()
    nulls = sum(r["nulls"] for r in counted)
    if nulls:
        raise ValueError(f"row key {key!r} is NULL in {nulls} rows")
    parts = sorted((r[_PART], r["n"]) for r in counted)
    firsts = accumulate((n for _, n in parts), initial=start)
    bases = spark.createDataFrame(
        [(part, first - (part << 33)) for (part, _), first in zip(parts, firsts)],
        f"{_PART} int, {_BASE} long",
    )
    rows = staged.join(F.broadcast(bases), _PART).withColumn(_PLACE, F.col(_PLACE) + F.col(_BASE))
    total = sum(n for _, n in parts)
    if n_rows is not None:
        rows, total = rows.where(F.col(_PLACE) < start + n_rows), min(total, n_rows)
    columns = [F.col(f"`{c}`") for c in df.columns if c != id_col]
    return rows.select(F.col(_PLACE).alias(id_col), *columns), total
