"""From raw documents to token files: five stages, each reading what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweave.llm.common import read_table
from promptweave.llm.decontaminate import drop_contaminated
from promptweave.llm.mixing import mix_sources
from promptweave.llm.quality import fit_quality, keep_quality
from promptweave.llm.queries import TOKENIZER
from promptweave.llm.simhash import keep_one_per_component
from promptweave.llm.tokens import read_tokens, write_tokens
from promptweave.session import scratch_path


#: Column for the order of the token files; an input's column of that name is not asked for there.
MIX_ORDER = "_mix_order"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    return keep_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_per_component(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the target weights of their sources ask for."""
    return mix_sources(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids are in the token files, with their checksum.

    The files hold the mixture in random order, copies of a document apart.
    """
    folder = scratch_path(spark, "corpus-tokens")
    shuffled = docs.withColumn(MIX_ORDER, F.xxhash64(F.monotonically_increasing_id(), "doc_id"))
    return read_tokens(spark, folder, write_tokens(shuffled, folder, TOKENIZER, order=[MIX_ORDER]))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", simhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL has no boosted trees, SimHash components or tokenizer; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
