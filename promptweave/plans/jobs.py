"""The jobs in the order they feed each other: collect, label, store, featurise."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweave.config import LabelRules
from promptweave.functions.conversation import first_message
from promptweave.operators.features import assemble, with_text_features
from promptweave.operators.labeling import audit_table, labeled_prompts, watched
from promptweave.operators.partitioning import spread
from promptweave.operators.tfidf import TfidfModel, fit_tfidf, widen
from promptweave.schemas import require_columns
from promptweave.session import scratch_path
from promptweave.sources import prompt_table, readers, writers


def collect_prompts(battles: DataFrame, conversation_col: str = "conversation_a") -> DataFrame:
    """Battles with the opening message as ``user_prompt``."""
    require_columns(battles, [conversation_col], "battles")
    return battles.withColumn("user_prompt", first_message(conversation_col))


def collect_job(
    spark: SparkSession,
    snapshot: str,
    out: str,
    split: str | None = None,
    as_csv: bool = False,
    key: str | None = "battle_id",
) -> None:
    """Snapshot to raw battles with all its columns. Parquet keeps the nesting and stays splittable.

    ``key`` names the column that the later jobs take as row key; None asks for none.
    """
    battles = readers.read_battles(spark, snapshot, split=split)
    collected = collect_prompts(require_columns(battles, [key] if key else [], snapshot))
    (writers.write_csv if as_csv else writers.write_parquet)(collected, out)


def label_job(
    spark: SparkSession,
    raw: str,
    out: str,
    rules: LabelRules = LabelRules(),
    key: str = "battle_id",
    as_csv: bool = False,
    na_words: Iterable[str] = (),
    key_type: T.DataType = T.LongType(),
) -> DataFrame:
    """Raw battles to labelled prompts; returns the table written, keyed for what follows.

    ``key_type`` is the type of the key where a CSV leaves it open.
    """
    if as_csv:
        same = {"keep": (key,), "na_words": na_words, "key_type": key_type}
        battles = readers.read_raw_battles_csv(spark, raw, rules, **same)
        writers.write_csv(labeled_prompts(battles, rules, keep=(key,)), out)
        return readers.read_labeled_csv(spark, out, **same)
    battles = readers.read_battles(spark, raw, schema=None)
    writers.write_parquet(labeled_prompts(battles, rules, keep=(key,)), out)
    return spark.read.parquet(out)


def audited_label_job(
    spark: SparkSession,
    raw: str,
    out: str,
    rules: LabelRules = LabelRules(),
    key: str = "battle_id",
) -> tuple[DataFrame, DataFrame]:
    """Raw battles to labelled prompts, and the drop audit, which the same scan counts.

    Counting looks at every row, so the scan has no pushed filters; ``label_job`` has them.
    """
    seen, counts = watched(readers.read_battles(spark, raw, schema=None), rules)
    writers.write_parquet(labeled_prompts(seen, rules, keep=(key,)), out)
    return spark.read.parquet(out), audit_table(spark, counts.get)


def store_job(
    labeled: DataFrame, key: str | None = "battle_id", table: str = prompt_table.PROMPT_TABLE
) -> DataFrame:
    """Labelled prompts to the stored table; returns its summary per tier."""
    prompt_table.save_prompts(labeled, key, table)
    return prompt_table.prompt_summary(labeled.sparkSession, table)


def document_job(
    labeled: DataFrame, path: str, tier: str, key: str | None = "battle_id", n_docs: int | None = 100
) -> DataFrame:
    """Export the first prompts as JSON documents and find those of one tier."""
    writers.export_documents(labeled, path, key, n_docs)
    return readers.find_documents(labeled.sparkSession, path, tier)


def featurise(prompts: DataFrame, model: TfidfModel, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Eight features, TF-IDF vector and label per prompt, all inside the row."""
    return assemble(model.transform(with_text_features(prompts)), model.out, keep)


def feature_job(
    spark: SparkSession,
    out: str,
    model_path: str,
    table: str = prompt_table.PROMPT_TABLE,
    as_csv: bool = False,
) -> TfidfModel:
    """Stored prompts to the feature table; the fitted model is saved for scoring.

    The CSV form has one column per term and neither id nor prompt. Its writer goes over
    its rows twice, so they are worked out once and kept as vectors in between.
    """
    prompts = spread(prompt_table.read_prompts(spark, table))
    model = fit_tfidf(prompts)
    model.save(spark, model_path)
    features = featurise(prompts, model)
    if as_csv:
        staged = scratch_path(spark, "narrow")
        writers.write_parquet(features.drop("id"), staged)
        wide = widen(spark.read.parquet(staged), model)
        label_last = [c for c in wide.columns if c != "Target_Tier"] + ["Target_Tier"]
        writers.write_csv(wide.select(*[F.col(f"`{c}`") for c in label_last]), out)
    else:
        writers.write_parquet(features, out)
    return model
