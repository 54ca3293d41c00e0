"""The jobs end to end, on files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweave.config import LabelRules, Tier
from promptweave.functions.conversation import first_messages

from promptweave.functions.text import TEXT_FEATURES
from promptweave.operators.labeling import labeled_prompts
from promptweave.operators.tfidf import TfidfModel
from promptweave.plans import jobs
from promptweave.plans.reports import feature_report
from promptweave.sources import prompt_table, readers, writers
from promptweave.streaming.scoring import prompt_stream, score_stream

TABLE = "prompts_of_jobs"


@pytest.fixture
def snapshot(spark, tmp_path):
    """Battles with nested conversations, split over two named splits."""
    talk = F.array(
        F.struct(F.concat(F.lit("Explain \"topic\",\nnumber "), "id").alias("content"), F.lit("user").alias("role")),
        F.struct(F.lit("reply").alias("content"), F.lit("assistant").alias("role")),
    )
    path = str(tmp_path / "snapshot")
    spark.range(60).select(
        F.col("id").alias("battle_id"),
        F.lit("gpt-4").alias("model_a"),
        F.lit("koala-13b").alias("model_b"),
        F.when(F.col("id") % 3 == 0, "model_a").when(F.col("id") % 3 == 1, "model_b").otherwise("tie").alias("winner"),
        F.when(F.col("id") % 10 != 4, talk).alias("conversation_a"),
        F.when(F.col("id") < 50, "train").otherwise("test").alias("split"),
    ).write.parquet(path)
    return path


@pytest.mark.parametrize("as_csv", [False, True])
def test_all_jobs(spark, snapshot, tmp_path, as_csv):
    paths = {n: str(tmp_path / n) for n in ("raw", "labeled", "documents", "features", "model")}
    jobs.collect_job(spark, snapshot, paths["raw"], split="train", as_csv=as_csv)
    labeled = jobs.label_job(spark, paths["raw"], paths["labeled"], as_csv=as_csv)
    kept = [i for i in range(50) if i % 3 != 2 and i % 10 != 4]
    rows = labeled.orderBy("battle_id").collect()
    assert [r["battle_id"] for r in rows] == kept
    assert rows[0]["user_prompt"] == 'Explain "topic",\nnumber 0'

    summary = jobs.store_job(labeled, table=TABLE).collect()
    assert sum(r["prompt_count"] for r in summary) == len(kept)
    found = jobs.document_job(labeled, paths["documents"], "Tier_2_API", n_docs=6)
    assert sorted(r["doc_id"] for r in found.collect()) == [
        n for n, i in enumerate(kept[:6]) if i % 3 == 0
    ]

    model = jobs.feature_job(spark, paths["features"], paths["model"], TABLE, as_csv=as_csv)
    assert TfidfModel.load(spark, paths["model"]).terms == model.terms
    if as_csv:
        wide = spark.read.option("header", True).csv(paths["features"])
        assert wide.columns == [*TEXT_FEATURES, *[f"tfidf_{t}" for t in model.terms], "Target_Tier"]
        assert wide.count() == len(kept)
    else:
        features = spark.read.parquet(paths["features"])
        assert features.columns == ["id", *TEXT_FEATURES, "tfidf", "Target_Tier"]
        assert [r["id"] for r in features.orderBy("id").collect()] == list(range(len(kept)))
        report = {r["metric"]: (r["value"], r["pct"]) for r in feature_report(features, len(model.terms)).collect()}
        assert report["input_rows"] == (len(kept), None)
        assert report["total_feature_columns"] == (8 + len(model.terms), None)
        shares = [v for k, v in report.items() if k.startswith("tier:")]
        assert sum(n for n, _ in shares) == len(kept)
        assert sum(p for _, p in shares) == pytest.approx(100)
    spark.sql(f"DROP TABLE {TABLE}")


@pytest.mark.parametrize("as_csv", [False, True])
def test_own_rules_reach_the_table(spark, tmp_path, as_csv):
    rules = LabelRules(tiers=(Tier("T", ("m",)),), prompt_col="question")
    rows = [("q2", "b", "m", "x", "model_a"), ("q1", " a ", "x", "m", "model_b"), ("q3", "c", "x", "m", "model_a")]
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, "question_id string, question string, model_a string, model_b string, winner string")
    (jobs.writers.write_csv if as_csv else jobs.writers.write_parquet)(df, raw)
    labeled = jobs.label_job(spark, raw, out, rules, key="question_id", as_csv=as_csv, key_type=T.StringType())
    jobs.store_job(labeled, "question_id", TABLE)
    stored = prompt_table.fetch_prompts(spark, table=TABLE).collect()
    assert [tuple(r) for r in stored] == [(0, "a", "T"), (1, "b", "T")]
    jobs.store_job(labeled.drop("question_id"), None, TABLE)
    assert sorted(r["id"] for r in prompt_table.read_prompts(spark, TABLE).collect()) == [0, 1]
    spark.sql(f"DROP TABLE {TABLE}")


def test_collection_needs_its_key(spark, snapshot, tmp_path):
    with pytest.raises(ValueError, match="question_id"):
        jobs.collect_job(spark, snapshot, str(tmp_path / "raw"), key="question_id")
    jobs.collect_job(spark, snapshot, str(tmp_path / "raw"), key=None)
    assert "split" in spark.read.parquet(str(tmp_path / "raw")).columns


def test_equal_turns_have_one_answer(spark):
    rows = [(1, 0, "b"), (1, 0, "a"), (1, 1, "c"), (2, 3, "x"), (2, 3, None), (3, None, "n"), (3, 0, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    found = {r["conv_id"]: r["user_prompt"] for r in first_messages(df.repartition(4)).collect()}
    assert found[1] == "a" and found[2] == ""


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "Target_Tier string")
    rows = {r["metric"]: r["value"] for r in feature_report(empty, 3).collect()}
    assert rows == {
        "input_rows": 0, "statistical_features": 5, "semantic_features": 3,
        "tfidf_features": 3, "total_feature_columns": 11,
    }


def test_rows_without_a_tier_count_in_the_total(spark):
    df = spark.createDataFrame([("A",), (None,), ("A",), ("B",)], "Target_Tier string")
    rows = {r["metric"]: (r["value"], r["pct"]) for r in feature_report(df, 3).collect()}
    assert rows["input_rows"] == (4, None)
    assert rows["tier:A"] == (2, 50.0) and rows["tier:B"] == (1, 25.0)


def test_raw_battles_without_a_conversation(spark):
    with pytest.raises(ValueError, match="conversation_a"):
        jobs.collect_prompts(spark.range(1))


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    texts = ["Explain the red apple.", None, "", "red apple pie, prove it!", "zażółć gęślą"]
    rows = [(i, t, "A") for i, t in enumerate(texts)]
    prompts = spark.createDataFrame(rows, "id long, user_prompt string, Target_Tier string")
    model = jobs.fit_tfidf(prompts)
    prompts.where("id < 3").write.parquet(landing)
    score_stream(prompt_stream(spark, landing), model, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    prompts.where("id >= 3").write.mode("append").parquet(landing)
    score_stream(prompt_stream(spark, landing), model, out, checkpoint).awaitTermination()
    streamed = spark.read.parquet(out).orderBy("id").collect()
    assert streamed == jobs.featurise(prompts, model).orderBy("id").collect()


def test_features_of_the_wide_csv_are_worked_out_once(spark, battles, tmp_path, monkeypatch):
    """The writer goes over its rows twice: they come from a file, not from the texts."""
    table, plans, real = "prompts_for_csv", [], writers.write_csv
    prompt_table.save_prompts(labeled_prompts(battles, keep=("battle_id",)), "battle_id", table, path=str(tmp_path / "t"))

    def seen(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(writers, "write_csv", seen)
    jobs.feature_job(spark, str(tmp_path / "csv"), str(tmp_path / "model"), table, as_csv=True)
    assert len(plans) == 1 and "regexp" not in plans[0]
