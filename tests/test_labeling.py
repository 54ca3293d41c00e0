from __future__ import annotations

import pytest

from promptweave.config import LabelRules, Tier
from promptweave.operators import labeling, summaries


def test_kept_rows(battles):
    kept = labeling.labeled_prompts(battles, keep=("battle_id",)).orderBy("battle_id").collect()
    assert [tuple(r) for r in kept] == [
        (0, "Explain TCP", "Tier_2_API"),
        (1, "hi", "Tier_1_Local"),
        (8, "x", "Tier_2_API"),
    ]


def test_lookup_join_gives_the_same(battles):
    cols = ["battle_id", "winning_model", "Target_Tier"]
    one = labeling.label_wins(battles).select(cols).orderBy("battle_id").collect()
    two = labeling.label_wins_by_lookup(battles).select(cols).orderBy("battle_id").collect()
    assert one == two


def test_audit(battles):
    rows = labeling.drop_audit(battles).collect()
    assert [tuple(r)[:4] + (r["remaining"],) for r in rows] == [
        (1, "null_prompt", 13, 2, 11),
        (2, "blank_prompt", 11, 1, 10),
        (3, "no_decisive_winner", 10, 4, 6),
        (4, "unlisted_model", 6, 3, 3),
    ]
    assert rows[0]["dropped_pct"] == pytest.approx(200 / 13)


def test_audit_of_nothing(battles):
    rows = labeling.drop_audit(battles.limit(0)).collect()
    assert [tuple(r)[2:] for r in rows] == [(0, 0, 0.0, 0)] * 4


def test_audit_agrees_with_the_filters(battles):
    left = labeling.drop_audit(battles).collect()[-1]["remaining"]
    assert left == labeling.label_wins(battles).count()
    assert left == battles.where(labeling.drop_rule() == 0).count()


def test_missing_column_is_named_before_any_job(battles):
    with pytest.raises(ValueError, match="winner"):
        labeling.labeled_prompts(battles.drop("winner"))


def test_rules_are_injectable(spark):
    rules = LabelRules(
        tiers=(Tier("small", ("a", "both")), Tier("large", ("b", "both"))),
        decisive_winners=("model_a", "model_b", "model_c"),
        prompt_col="q",
        winner_col="w",
        model_a_col="m1",
        model_b_col="m2",
    )
    rows = [("p", "model_a", "a", "b"), ("p", "model_b", "a", "b"), ("p", "model_c", "a", "both")]
    df = spark.createDataFrame(rows, "q string, w string, m1 string, m2 string")
    tiers = [r["Target_Tier"] for r in labeling.label_wins(df, rules).collect()]
    assert tiers == ["small", "large", "small"]
    listed = {r[0]: r[1] for r in rules.tier_table(spark).collect()}
    assert listed == {"a": "small", "b": "large", "both": "small"}


def test_rules_cannot_be_changed():
    with pytest.raises(AttributeError):
        LabelRules().winner_col = "other"


def test_summaries(battles):
    labeled = labeling.label_wins(battles)
    report = [tuple(r) for r in summaries.tier_report(labeled).collect()]
    assert [(t, n, round(p, 2)) for t, n, p, _ in report] == [
        ("Tier_2_API", 2, 66.67),
        ("Tier_1_Local", 1, 33.33),
    ]
    assert report[0][3] == "█" * 33 + "░" * 17
    assert tuple(summaries.imbalance(labeled).first()) == (2.0, True)
    assert [tuple(r) for r in summaries.model_coverage(labeled).collect()] == [
        ("gpt-4", "Tier_2_API", 2),
        ("koala-13b", "Tier_1_Local", 1),
    ]
    winners = [tuple(r) for r in summaries.value_counts(battles, "winner").collect()]
    assert winners == [("model_a", 7), ("tie", 2), (" model_a ", 1), ("model_b", 1), ("tie (bothbad)", 1)]


def test_imbalance_edges(spark):
    empty = spark.createDataFrame([], "Target_Tier string")
    assert tuple(summaries.imbalance(empty).first()) == (None, False)
    one = spark.createDataFrame([("a",), ("a",), (None,)], "Target_Tier string")
    assert tuple(summaries.imbalance(one).first()) == (1.0, False)
    edge = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "Target_Tier string")
    assert tuple(summaries.imbalance(edge).first()) == (1.5, False)
