"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweave.llm.common import read_table
from promptweave.llm.conversation_repair import damaged, repair_report
from promptweave.llm.decontaminate import decontamination_report
from promptweave.llm.main_text import main_text
from promptweave.llm.mixing import mix_sources
from promptweave.llm.order_minhash import fingerprints
from promptweave.llm.pii import pii_report
from promptweave.llm.quality import fit_quality, score_documents
from promptweave.llm.repeats import repeats_report
from promptweave.llm.simhash import simhash_components
from promptweave.llm.spelling import spelling_report
from promptweave.llm.tokens import read_tokens, write_tokens
from promptweave.llm.vector_dedup import vector_components
from promptweave.llm.warc import assemble_captures, read_archives, write_archives
from promptweave.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.round("rate", 6))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), folder)
    captures = assemble_captures(read_archives(spark, folder))
    return captures.select(
        F.col("metadata")[0]["page_id"].alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.col("metadata")[0]["refers_to_page"].alias("refers_to"),
        F.col("capture.digest_holds").alias("digest_holds"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(read_table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(read_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    manifest = write_tokens(read_table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return read_tokens(spark, folder, manifest)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(read_table(spark, sf_dir, "conversations")))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_report(read_table(spark, sf_dir, "documents"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_order_minhash,
        op3_warc,
        op4_pii,
        op5_repeats,
        op6_token_files,
        op7_main_text,
        op8_decontaminate,
        op9_simhash,
        op10_quality,
        op11_conversation_repair,
        op12_spelling_groups,
        op13_vector_dedup,
    )
}
