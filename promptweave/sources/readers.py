"""Scans: landed battle snapshots, CSV, prompt documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweave.config import LabelRules
from promptweave.schemas import LABELED, PROMPT_DOCUMENTS, require_columns
from promptweave.sources.split_files import json_objects, largest_file, split_csv
from promptweave.sources.writers import CSV_FILE_BYTES


def _load(reader: DataFrameReader, path: str, hint: str) -> DataFrame:
    return _found(lambda: reader.load(path), path, hint)


def _found(load: Callable[[], DataFrame], path: str, hint: str) -> DataFrame:
    """Load a path; if it is missing, say which earlier job writes it."""
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"{path} does not exist: {hint}") from error


def read_battles(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    split: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A landed snapshot of model comparisons with all its columns; ``split`` picks one named split.

    Give a ``schema`` where the format declares none, such as ``BATTLES`` for JSON.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        if split is not None and "split" not in schema.names:
            schema = T.StructType([*schema.fields, T.StructField("split", T.StringType())])
        reader = reader.schema(schema)
    battles = _load(reader, path, "land a snapshot of the dataset first")
    if split is None:
        return battles
    return require_columns(battles, ["split"], path).where(F.col("split") == split)


# CSV as spreadsheets and pandas write it: doubled quotes, raw newlines in quotes.
CSV_OPTIONS = {"quote": '"', "escape": '"'}
SPLIT_ABOVE = CSV_FILE_BYTES


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    columns: Iterable[str] | None = None,
    na_words: Iterable[str] = (),
    hint: str = "write the CSV first",
    split_above: int | None = SPLIT_ABOVE,
    place: str | None = None,
) -> DataFrame:
    """CSV with a header, columns matched by name and cast to ``schema``.

    Files larger than ``split_above`` bytes are read by many tasks each, although
    quoted fields may hold line ends: one pass counts quotes, the next cuts and
    parses. Smaller ones, as the writer here makes them, are a task each. So are all
    if it is None, as files need in which quotes stand alone in unquoted fields.
    ``place`` names a column that sorts the rows in file order, a row key where there
    is no other; it needs ``split_above=0``. ``na_words`` lists texts to take as NULL; by default
    they stay text. CSV has no empty text apart from a missing one, so both come
    back as NULL.
    """
    if place is not None and split_above != 0:
        raise ValueError("place needs split_above=0")
    largest = _found(lambda: largest_file(spark, path), path, hint) if split_above else 0
    if split_above is not None and largest >= split_above:
        found = _found(lambda: split_csv(spark, path, CSV_OPTIONS, place), path, hint)
    else:
        reader = spark.read.format("csv").options(header=True, multiLine=True, encoding="UTF-8", **CSV_OPTIONS)
        found = _load(reader, path, hint)
    wanted = list(columns) if columns is not None else schema.names
    require_columns(found, wanted, path)
    typed = [F.col(f"`{c}`").cast(schema[c].dataType).alias(c) for c in wanted]
    missing = list(na_words)
    if missing:
        texts = {c for c in wanted if isinstance(schema[c].dataType, T.StringType)}
        typed = [
            F.when(~F.col(f"`{c}`").isin(missing), F.col(f"`{c}`")).alias(c) if c in texts else t
            for c, t in zip(wanted, typed)
        ]
    return found.select(*typed, *([place] if place else []))


def read_raw_battles_csv(
    spark: SparkSession,
    path: str,
    rules: LabelRules = LabelRules(),
    keep: tuple[str, ...] = (),
    na_words: Iterable[str] = (),
    key_type: T.DataType = T.LongType(),
    split_above: int | None = SPLIT_ABOVE,
) -> DataFrame:
    """The columns labelling needs, plus row keys named in ``keep``, from a collected CSV."""
    fields = [T.StructField(c, key_type) for c in keep]
    fields += [T.StructField(c, T.StringType()) for c in rules.input_columns]
    return read_csv(
        spark, path, T.StructType(fields), na_words=na_words, hint="run the collection job first", split_above=split_above
    )


def read_labeled_csv(
    spark: SparkSession,
    path: str,
    keep: tuple[str, ...] = (),
    na_words: Iterable[str] = (),
    key_type: T.DataType = T.LongType(),
    split_above: int | None = SPLIT_ABOVE,
) -> DataFrame:
    fields = [T.StructField(c, key_type) for c in keep] + list(LABELED.fields)
    return read_csv(
        spark, path, T.StructType(fields), na_words=na_words, hint="run the labelling job first", split_above=split_above
    )


def read_documents(spark: SparkSession, path: str, single_array: bool = False) -> DataFrame:
    """Prompt documents: one JSON object per line, or a file holding one JSON array.

    A key that a document lacks is NULL. An array file is cut into its documents
    by many tasks.
    """
    hint = "export the documents first"
    if single_array:
        objects = _found(lambda: json_objects(spark, path), path, hint)
        parsed = objects.select(F.from_json("record", PROMPT_DOCUMENTS).alias("document"))
        return parsed.select("document.*")
    return _load(spark.read.format("json").schema(PROMPT_DOCUMENTS), path, hint)


def find_documents(
    spark: SparkSession, path: str, tier: str, single_array: bool = False
) -> DataFrame:
    """Documents of one tier; a document without a tier matches none."""
    return read_documents(spark, path, single_array).where(F.col("Target_Tier") == tier)
