"""Sinks: CSV, Parquet and JSON documents."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweave.operators.row_ids import numbered
from promptweave.sources.one_file import write_one_file

CSV_FILE_BYTES = 128 << 20
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "encoding": "UTF-8",
}


def _flat(df: DataFrame) -> DataFrame:
    """Arrays, records and maps as JSON text, since CSV holds only scalars."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def _rows_for(flat: DataFrame, file_bytes: int) -> int:
    """Rows of mean size that make up a file of ``file_bytes``."""
    mean = flat.agg(F.avg(F.octet_length(F.to_csv(F.struct("*"))))).first()[0]
    return max(1, int(file_bytes / mean)) if mean else 1


def write_csv(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    file_bytes: int = CSV_FILE_BYTES,
    rows_per_file: int | None = None,
    one_file: bool = False,
    order: tuple[str | Column, ...] = (),
) -> None:
    """CSV with header, doubled quotes and untouched spaces, in files of about ``file_bytes`` at most.

    The writer splits by rows, so their mean size is taken first, in a pass over
    ``df``; give ``rows_per_file`` to save that pass. ``one_file`` makes one file of any
    size, of rows sorted by ``order``, which many tasks write.
    """
    vectors = [f.name for f in df.schema if isinstance(f.dataType, VectorUDT)]
    if vectors:
        raise ValueError(f"vector columns {vectors} do not fit CSV; widen them first")
    if order and not one_file:
        raise ValueError("order needs one_file=True")
    flat = _flat(df)
    if one_file:
        write_one_file(flat, path, "csv", CSV_OPTIONS, mode, order)
        return
    rows = rows_per_file or _rows_for(flat, file_bytes)
    flat.write.mode(mode).options(**CSV_OPTIONS, maxRecordsPerFile=rows).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def _first_documents(df: DataFrame, key: str | None, n_docs: int | None) -> tuple[DataFrame, int]:
    rows, n = numbered(df, key, "__doc_id", n_rows=n_docs)
    payload = [F.col(f"`{c}`") for c in df.columns if c not in (key, "doc_id")]
    return rows.select(F.col("__doc_id").alias("doc_id"), *payload), n


def first_documents(df: DataFrame, key: str | None, n_docs: int | None = 100) -> DataFrame:
    """First rows by key with a dense ``doc_id`` from 0, other columns as they are.

    ``n_docs=None`` numbers every row. Rows of equal keys are ordered by a hash,
    a NULL key is an error, whatever ``n_docs`` is.
    """
    return _first_documents(df, key, n_docs)[0]


def export_documents(df: DataFrame, path: str, key: str | None, n_docs: int | None = 100) -> int:
    """Write the first documents, or all with ``n_docs=None``, as JSON lines; returns how many."""
    documents, n = _first_documents(df, key, n_docs)
    documents.write.mode("overwrite").json(path)
    return n
