"""A tier classifier on the TF-IDF vectors, and its figures on prompts it has not seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweave.config import PROMPT_COL, TIER_COL
from promptweave.operators.tfidf import TfidfModel
from promptweave.schemas import require_columns

HELD_OUT_OF_TEN = 2
MAX_ITER = 40
REGULARISATION = 1e-3


def held_out(text: str = PROMPT_COL, tenths: int = HELD_OUT_OF_TEN) -> Column:
    """Whether a prompt is kept from training: by a hash of its text, so that copies stay on one side."""
    digits = F.substring(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), 1, 4)
    return F.conv(digits, 16, 10).cast("long") % 10 < tenths


def balanced_weight(counts: dict[str, int], label: str = TIER_COL) -> Column:
    """Weight of a row such that all labels weigh the same in sum."""
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for name, n in counts.items():
        weight = F.when(F.col(label) == name, total / (len(counts) * n)).otherwise(weight)
    return weight


def fit_tier_classifier(
    labeled: DataFrame,
    model: TfidfModel,
    label: str = TIER_COL,
    max_iter: int = MAX_ITER,
    regularisation: float = REGULARISATION,
) -> PipelineModel:
    """Logistic regression on the sparse vectors of ``model``, one coefficient vector per label.

    Gradients are summed over all rows by Spark; the driver holds one number per term
    and label. Labels count the same however many rows they have. Rows without a label
    or a prompt play no part; fewer than two labels are an error.
    """
    require_columns(labeled, [label, PROMPT_COL], "labelled prompts")
    usable = labeled.where(F.col(label).isNotNull() & F.col(PROMPT_COL).isNotNull())
    counts = {r[label]: r["n"] for r in usable.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        raise ValueError(f"a classifier needs two labels at least, there are {sorted(counts)}")
    names = sorted(counts)
    indexer = StringIndexerModel.from_labels(names, inputCol=label, outputCol="__label", handleInvalid="keep")
    vectors = model.transform(usable.select(PROMPT_COL, label)).withColumn("__weight", balanced_weight(counts, label))
    regression = LogisticRegression(
        featuresCol=model.out,
        labelCol="__label",
        weightCol="__weight",
        predictionCol="__predicted",
        probabilityCol="tier_probability",
        rawPredictionCol="__raw",
        maxIter=max_iter,
        regParam=regularisation,
        standardization=False,
    )
    fitted = regression.fit(indexer.transform(vectors))
    named = IndexToString(inputCol="__predicted", outputCol="predicted_tier", labels=names)
    return PipelineModel([model.pipeline, fitted, named])


def predict_tiers(prompts: DataFrame, classifier: PipelineModel) -> DataFrame:
    """Adds ``predicted_tier``; row by row, so streams do as well. A null prompt counts as an empty one."""
    columns = [F.col(f"`{c}`") for c in prompts.columns]
    filled = prompts.withColumn("__prompt", F.col(PROMPT_COL)).withColumn(PROMPT_COL, F.coalesce(PROMPT_COL, F.lit("")))
    predicted = classifier.transform(filled).withColumn(PROMPT_COL, F.col("__prompt"))
    return predicted.select(*columns, "predicted_tier")


def confusion(predicted: DataFrame, label: str = TIER_COL, prediction: str = "predicted_tier") -> DataFrame:
    """``(label, prediction, n)`` of all pairs that occur."""
    pairs = predicted.select(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
    return pairs.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def class_report(confused: DataFrame) -> DataFrame:
    """Per label: rows, how often it was predicted and hit, precision, recall and F1; from confusion counts.

    A share of nothing is NULL. The table is as large as the labels squared, so the joins are tiny.
    """
    real = confused.groupBy("label").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hits")
    )
    guessed = confused.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    both = real.join(guessed, "label", "full").fillna(0, ["rows", "hits", "predicted"])
    precision = F.col("hits") / F.nullif("predicted", F.lit(0))
    recall = F.col("hits") / F.nullif("rows", F.lit(0))
    f1 = F.lit(2.0) * F.col("hits") / F.nullif(F.col("rows") + F.col("predicted"), F.lit(0))
    return both.select(
        "label", "rows", "predicted", "hits", precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
    )


def evaluate_tiers(
    labeled: DataFrame, model: TfidfModel, labels: Sequence[str] | None = None
) -> tuple[PipelineModel, DataFrame]:
    """A classifier fitted on eight tenths of the prompts, and its report on the others."""
    if labels is not None:
        labeled = labeled.where(F.col(TIER_COL).isin(*labels))
    classifier = fit_tier_classifier(labeled.where(~held_out()), model)
    unseen = labeled.where(held_out() & F.col(TIER_COL).isNotNull())
    return classifier, class_report(confusion(predict_tiers(unseen, classifier)))
