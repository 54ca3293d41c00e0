"""Mixing sources to target weights by Poisson replication, with built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweave.llm.common import join_checked, stored, text_or_empty

ALPHA = 0.5
EPOCHS = 1.0
SEED = 17
HEX_DIGITS = 13


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def poisson_steps(rate: str) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, up to where it differs from 1 no more.

    Probabilities are carried as logarithms, so a large rate does not underflow.
    """
    last = f"CAST(ceil({rate} + 12 * sqrt({rate}) + 30) AS INT)"
    return F.expr(
        f"""aggregate(
            sequence(1, {last}),
            named_struct('log', -{rate}, 'steps', array(exp(-{rate}))),
            (a, k) -> named_struct(
                'log', a.log + ln({rate}) - ln(k),
                'steps', concat(a.steps, array(element_at(a.steps, -1) + exp(a.log + ln({rate}) - ln(k))))),
            a -> a.steps)"""
    )


def repetition_rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS
) -> DataFrame:
    """``(source, rate)``: mean number of copies per document that gives each source its weight.

    Sizes are characters, summed before they are shuffled. Without ``weights`` a
    source weighs its size to the power ``alpha``. All sources together keep
    ``epochs`` times their size. A source that is not among the weights has
    rate 0, one without any character has rate ``epochs``. Null counts as ''.
    """
    sizes = stored(
        docs.select(F.coalesce("source", F.lit("")).alias("source"), F.length(text_or_empty()).alias("chars"))
        .groupBy("source")
        .agg(F.sum("chars").alias("chars"))
    )
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(alpha)))
    else:
        named = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        weighed = join_checked(sizes, named, ["source"], rows=len(weights)).fillna(0.0, ["weight"])
    total = weighed.agg(
        F.sum("chars").alias("chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight"))).alias("weight")
    ).first()
    share = F.col("weight") / F.lit(float(total["weight"] or 1.0))
    rate = F.lit(epochs * float(total["chars"] or 0)) * share / F.col("chars")
    return weighed.select("source", F.when(F.col("chars") > 0, rate).otherwise(F.lit(epochs)).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = ALPHA,
    epochs: float = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Every document as often as its draw says, in a random order over all sources.

    Adds ``copy`` (1, 2, ...), ``rate`` and ``mix_key`` (the order) to the columns
    of ``docs``. The draw inverts the Poisson distribution of the source's rate at
    a number hashed from the doc_id: the same in every run and on any cluster.
    Rows that share a doc_id share the draw; a null doc_id counts as ''. Empty
    texts are drawn like others.
    """
    rates = stored(repetition_rates(docs, weights, alpha, epochs))
    steps = rates.select(
        F.col("source").alias("_source"),
        F.col("rate").alias("_rate"),
        F.when(F.col("rate") > 0, poisson_steps("rate")).otherwise(F.array(F.lit(2.0))).alias("_steps"),
    )
    drawn = join_checked(
        docs.withColumn("_source", F.coalesce("source", F.lit(""))), steps, ["_source"], "inner", rows=rates.count()
    )
    draw = uniform(seed, F.col("doc_id"))
    drawn = drawn.withColumn("_draw", draw).withColumn("_n", F.expr("size(filter(_steps, s -> s <= _draw))"))
    copies = drawn.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_copy")))
    others = [c for c in docs.columns if c not in ("copy", "rate", "mix_key")]
    mixed = copies.select(
        *others, F.col("_copy").alias("copy"), F.col("_rate").alias("rate"), order.alias("mix_key")
    )
    return mixed.repartition("mix_key").sortWithinPartitions("mix_key")
