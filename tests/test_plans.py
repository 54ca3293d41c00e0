"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from promptweave.operators import labeling, summaries, tfidf
from promptweave.operators.features import with_text_features
from promptweave.operators.partitioning import INPUT_TASKS, spread
from promptweave.operators.row_ids import with_dense_id
from promptweave.sources import prompt_table
from promptweave.functions.constants import ENGLISH_STOP_WORDS
from promptweave.functions.terms import content_words_sql, terms_sql
from tests.conftest import SMALL
from workload.battles import read_table
from workload.queries import QUERIES

UNWANTED = ("PythonUDF", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


#: Its dense matrix product per row has no built-in form.
IN_PYTHON = {"document_clusters"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - IN_PYTHON))
def test_no_python_and_no_pairing_of_all_rows(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert not [u for u in UNWANTED if u in plan]


@pytest.fixture
def stored_battles(spark, battles, tmp_path):
    path = str(tmp_path / "battles")
    battles.write.parquet(path)
    return spark.read.parquet(path)


def test_labelling_is_one_stage_with_pushed_filters(stored_battles):
    plan = plan_of(labeling.labeled_prompts(stored_battles))
    assert "Exchange" not in plan
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert "IsNotNull(user_prompt)" in pushed and "In(winner" in pushed
    assert "battle_id" not in plan.split("ReadSchema:")[1]


def test_audit_reads_the_battles_once(stored_battles):
    plan = plan_of(labeling.drop_audit(stored_battles))
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange") == 1


def test_the_only_global_window_is_above_the_grouping(stored_battles):
    plan = plan_of(summaries.tier_shares(labeling.label_wins(stored_battles)))
    window, grouping = plan.index("Window"), plan.index("HashAggregate")
    assert window < grouping


def test_ids_have_no_global_window(spark):
    lines = read_table(spark, SMALL, "lineitem").select("l_orderkey", "l_linenumber")
    plan = plan_of(with_dense_id(lines, "l_orderkey"))
    assert "SinglePartition" not in plan and "Window" not in plan
    assert "BroadcastHashJoin" in plan


def test_fetch_of_a_tier_prunes_the_others(spark, battles):
    table = "prompts_for_pruning"
    prompt_table.save_prompts(labeling.labeled_prompts(battles, keep=("battle_id",)), "battle_id", table)
    plan = plan_of(prompt_table.fetch_prompts(spark, "Tier_2_API", table))
    assert re.search(r"PartitionFilters: \[[^\]]*Target_Tier[^\]]*= Tier_2_API", plan)
    assert "IsNotNull(user_prompt)" in plan
    spark.sql(f"DROP TABLE {table}")


def test_features_and_scores_are_row_local(spark):
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text")
    assert "Exchange" not in plan_of(with_text_features(docs, "text"))
    model = tfidf.fit_tfidf(docs, "text", max_features=50)
    assert "Exchange" not in plan_of(model.transform(docs))


def test_texts_are_tokenised_once_per_row(spark):
    docs = read_table(spark, SMALL, "documents")
    for terms in (
        content_words_sql("text", ENGLISH_STOP_WORDS),
        terms_sql("text", ENGLISH_STOP_WORDS),
    ):
        plan = plan_of(tfidf.counted_terms(docs, terms))
        assert plan.count("regexp_extract_all") == 1


def test_terms_are_combined_before_their_one_shuffle(spark):
    docs = read_table(spark, SMALL, "documents")
    plan = plan_of(tfidf.counted_terms(docs, content_words_sql("text", ())))
    assert plan.count("Exchange") == 1
    assert plan.count("HashAggregate") == 2


def test_shared_parts_are_computed_once(spark):
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text")
    plan = plan_of(with_text_features(docs, "text"))
    assert plan.count("lower(") == 1
    assert plan.count("split(trim(") == 1


def test_inputs_are_spread_on_request_only(spark):
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text")
    assert "Exchange" not in plan_of(spread(docs))
    assert "RoundRobinPartitioning(16)" in plan_of(spread(docs, 16))
    spark.conf.set(INPUT_TASKS, "12")
    assert "RoundRobinPartitioning(12)" in plan_of(spread(docs))
    spark.conf.unset(INPUT_TASKS)


def test_vectors_are_not_made_dense(spark):
    for name in ("tfidf_long", "tfidf_sparsity", "feature_matrix"):
        assert "vector_to_array" not in plan_of(QUERIES[name](spark, SMALL))
