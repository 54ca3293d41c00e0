from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from promptweave.operators.tfidf import fit_tfidf
from promptweave.plans.classifier import (
    class_report,
    confusion,
    evaluate_tiers,
    fit_tier_classifier,
    held_out,
    predict_tiers,
)
from workload.queries import QUERIES
from tests.conftest import SMALL


def prompts(spark, n=300):
    """Two tiers told apart by their words, one of them rare."""
    rows = []
    for i in range(n):
        rare = i % 10 == 0
        words = f"kernel matrix proof{i % 7}" if rare else f"hello weather joke{i % 7}"
        rows.append((f"{words} number{i}", "Hard" if rare else "Easy"))
    rows += [(None, "Easy"), ("hello", None), ("", "Easy")]
    return spark.createDataFrame(rows, "user_prompt string, Target_Tier string").repartition(4)


def test_rare_label_is_found(spark):
    labeled = prompts(spark)
    _, report = evaluate_tiers(labeled, fit_tfidf(labeled))
    found = {r["label"]: r for r in report.collect()}
    assert set(found) == {"Easy", "Hard"}
    assert found["Hard"]["recall"] == 1.0 and found["Hard"]["f1"] > 0.9
    unseen = labeled.where(held_out() & F.col("Target_Tier").isNotNull())
    assert sum(r["rows"] for r in found.values()) == sum(r["predicted"] for r in found.values()) == unseen.count()


def test_predictions_keep_the_rows(spark):
    labeled = prompts(spark)
    classifier = fit_tier_classifier(labeled, fit_tfidf(labeled))
    named = labeled.withColumn("__odd name", F.lit(1))
    predicted = predict_tiers(named, classifier)
    assert predicted.columns == [*named.columns, "predicted_tier"]
    assert sorted(map(str, predicted.drop("predicted_tier").collect())) == sorted(map(str, named.collect()))
    assert {r[0] for r in predicted.select("predicted_tier").distinct().collect()} <= {"Easy", "Hard"}
    assert predict_tiers(labeled.limit(0), classifier).collect() == []


def test_report(spark):
    rows = [("a", "a")] * 6 + [("a", "b")] * 2 + [("b", "a")] + [("b", "c")] + [("d", "a")]
    df = spark.createDataFrame(rows, "Target_Tier string, predicted_tier string")
    found = {r["label"]: tuple(r)[1:] for r in class_report(confusion(df)).collect()}
    assert found["a"] == (8, 8, 6, 0.75, 0.75, 0.75)
    assert found["b"] == (2, 2, 0, 0.0, 0.0, 0.0)
    assert found["c"] == (0, 1, 0, 0.0, None, 0.0) and found["d"] == (1, 0, 0, None, 0.0, 0.0)


def test_one_label_is_an_error(spark):
    labeled = prompts(spark).where("Target_Tier = 'Easy'")
    with pytest.raises(ValueError, match="two labels"):
        fit_tier_classifier(labeled, fit_tfidf(labeled))


def test_language_by_text(spark):
    found = {r["label"]: r for r in QUERIES["language_classifier"](spark, SMALL).collect()}
    assert set(found) == {"de", "en", "es", "fr"}
    assert sum(r["hits"] for r in found.values()) > 0.7 * sum(r["rows"] for r in found.values())
