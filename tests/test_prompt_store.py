"""Loads that count once, pruned reads, streamed labels with a running audit, stored term counts."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from promptweave.config import LabelRules
from promptweave.operators import labeling, tfidf
from promptweave.operators.row_ids import with_dense_id
from promptweave.operators.term_state import TermState
from promptweave.plans import jobs
from promptweave.sources import prompt_table
from promptweave.sources.prompt_store import PromptStore
from promptweave.streaming.labeling import battle_stream, label_stream


def labeled(spark, first, n, tiers=("Tier_1_Local", "Tier_2_API")):
    rows = [(first + i, None if i % 10 == 9 else f"p{first + i}", tiers[i % len(tiers)]) for i in range(n)]
    return spark.createDataFrame(rows, "battle_id long, user_prompt string, Target_Tier string").repartition(3)


def stored(store, **which):
    return sorted(tuple(r) for r in store.prompts(**which).collect())


def test_loads_count_once(spark, tmp_path):
    store = PromptStore(spark, str(tmp_path / "store"), block_rows=7)
    assert stored(store) == [] and store.head(3).collect() == [] and store.summary().collect() == []
    assert store.load(labeled(spark, 0, 20), "battle_id", "a") == 20
    assert store.load(labeled(spark, 500, 9), "battle_id", "a") == 20  # known by its name
    store._write(labeled(spark, 900, 40), "battle_id", "b", 20)  # breaks off before its commit
    assert len(stored(store)) == 20
    again = PromptStore(spark, str(tmp_path / "store"))
    assert again.block_rows == 7
    assert again.load(labeled(spark, 100, 15), "battle_id", "b") == 15
    assert again.load(labeled(spark, 0, 0), "battle_id", "c") == 0
    assert again.load(labeled(spark, 200, 5, (None, "T")), "battle_id", "d") == 5
    rows = stored(again)
    assert [r[0] for r in rows] == list(range(40))
    assert [r[1] for r in rows][18:22] == ["p18", None, "p100", "p101"]
    assert {r[2] for r in rows if r[0] >= 35} == {None, "T"}
    assert stored(again, first=13, last=24) == rows[13:25]
    assert stored(again, tier="T") == [r for r in rows if r[2] == "T"]
    with pytest.raises(ValueError, match="plain name"):
        again.load(labeled(spark, 0, 1), "battle_id", "../x")


def test_reads_of_few_files(spark, tmp_path):
    store = PromptStore(spark, str(tmp_path / "store"), block_rows=10)
    store.load(labeled(spark, 0, 200), "battle_id", "a")
    store.load(labeled(spark, 200, 200), "battle_id", "b")
    everything = len(store.prompts().inputFiles())
    assert everything >= 80
    head = store.head(5)
    assert [r["id"] for r in head.collect()] == [0, 1, 2, 3, 4]
    assert len({f for f in _scanned(head)}) <= 2
    assert len(_scanned(store.prompts(first=205, last=214))) <= 4
    assert len(_scanned(store.prompts("Tier_2_API", first=205, last=214))) <= 2
    assert [r["id"] for r in store.head(30, "Tier_1_Local").collect()] == list(range(0, 60, 2))
    assert store.head(1000).count() == 360


def _scanned(df):
    """Files that the rows come from, and a scan with filters on the partition columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"PartitionFilters: \[(.*?)\]", plan)
    assert found and all("id_block" in f for f in found)
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_rows_are_counted_as_they_are_written(spark, tmp_path):
    rows = labeled(spark, 0, 25)
    table = "prompts_counted"
    assert prompt_table.save_prompts(rows, "battle_id", table, path=str(tmp_path / "t")) == 25
    assert prompt_table.save_prompts(rows, "battle_id", table, mode="append", path=str(tmp_path / "t")) == 25
    assert prompt_table.save_prompts(rows.limit(0), "battle_id", table, mode="append", path=str(tmp_path / "t")) == 0


def test_label_job_with_audit(spark, battles, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    battles.write.parquet(raw)
    written, audit = jobs.audited_label_job(spark, raw, out)
    assert audit.collect() == labeling.drop_audit(battles).collect()
    plain = labeling.labeled_prompts(battles, keep=("battle_id",))
    assert sorted(map(str, written.collect())) == sorted(map(str, plain.collect()))
    seen, _ = labeling.watched(spark.read.parquet(raw))
    plan = labeling.labeled_prompts(seen)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan


def test_stream(spark, battles, tmp_path):
    landed, store = str(tmp_path / "landed"), PromptStore(spark, str(tmp_path / "store"))
    checkpoint = str(tmp_path / "checkpoint")

    def run():
        arriving = battle_stream(spark, landed, battles.schema, files_per_batch=1)
        label_stream(arriving, store, checkpoint).awaitTermination()

    battles.repartition(2).write.parquet(landed)
    run()
    run()  # nothing new
    battles.withColumn("battle_id", F.col("battle_id") + 100).coalesce(1).write.mode("append").parquet(landed)
    run()
    wanted = labeling.labeled_prompts(battles).collect() * 2
    rows = stored(store)
    assert [r[0] for r in rows] == list(range(len(wanted)))
    assert sorted(r[1:] for r in rows) == sorted(map(tuple, wanted))
    assert store.audit().collect() == labeling.drop_audit(battles.union(battles)).collect()


def test_a_batch_that_is_run_again_counts_once(spark, battles, tmp_path):
    """The crash after the commit of a load and before that of its batch."""
    landed, store = str(tmp_path / "landed"), PromptStore(spark, str(tmp_path / "store"))
    battles.write.parquet(landed)
    for checkpoint in ("one", "two"):  # a lost checkpoint gives the same batch number again
        arriving = battle_stream(spark, landed, battles.schema)
        label_stream(arriving, store, str(tmp_path / checkpoint)).awaitTermination()
    assert store.loads().count() == 1
    assert store.audit().collect() == labeling.drop_audit(battles).collect()


def test_term_state(spark, tmp_path):
    texts = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["red fish blue fish", "one fish", None, "", "red red apple", "the of"] * 3)],
        "k int, user_prompt string",
    )
    state = TermState(spark, str(tmp_path / "state"))
    with pytest.raises(ValueError, match="no terms"):
        state.fit()
    state.add(texts.where("k < 7"), "a")
    state.add(texts.where("k >= 7"), "b")
    state.add(texts.where("k >= 7"), "b")
    whole = tfidf.fit_tfidf(texts, max_features=5)
    for found in (state.fit(max_features=5), state.compact(str(tmp_path / "merged")).fit(max_features=5)):
        assert (found.vocabulary, found.n_docs) == (whole.vocabulary, whole.n_docs)
        assert found.transform(texts).collect() == whole.transform(texts).collect()
    with pytest.raises(ValueError, match="other stop words"):
        TermState(spark, str(tmp_path / "state"), ["fish"])
    with pytest.raises(ValueError, match="plain name"):
        state.add(texts, "a/b")


def test_winner_values(spark):
    with pytest.raises(ValueError, match="decisive_winners"):
        LabelRules(decisive_winners=("left", "right"))
    rules = LabelRules(decisive_winners=("left", "right"), model_a_wins="left")
    rows = [("left", "gpt-4", "koala-13b", "p"), ("right", "gpt-4", "koala-13b", "p"), ("model_a", "gpt-4", "x", "p")]
    df = spark.createDataFrame(rows, "winner string, model_a string, model_b string, user_prompt string")
    assert [r["winning_model"] for r in labeling.label_wins(df, rules).collect()] == ["gpt-4", "koala-13b"]


def test_ids_without_key_need_a_file_scan(spark, tmp_path):
    rows = labeled(spark, 0, 30)
    rows.write.parquet(str(tmp_path / "rows"))
    scan = spark.read.parquet(str(tmp_path / "rows"))
    assert with_dense_id(scan.where("battle_id > 3").select("user_prompt")).count() == 26
    for derived in (rows, scan.groupBy("battle_id").count(), scan.repartition(2), scan.union(scan)):
        with pytest.raises(ValueError, match="name a key"):
            with_dense_id(derived)


def test_many_first_rows(spark, monkeypatch):
    """Beyond the top rows of a sort, ids come first and are cut off."""
    from promptweave.operators import row_ids

    rows = labeled(spark, 0, 50)
    few = with_dense_id(rows, "battle_id", n_rows=20)
    monkeypatch.setattr(row_ids, "TOP_ROWS", 5)
    many = with_dense_id(rows, "battle_id", n_rows=20)
    assert sorted(few.collect()) == sorted(many.collect()) and many.count() == 20
    empty = spark.createDataFrame([], rows.schema)
    assert with_dense_id(empty, "battle_id", n_rows=20).count() == 0
