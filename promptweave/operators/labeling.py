"""Cleaning rules, winner resolution and tier labels, with a one-pass audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from promptweave.config import PROMPT_COL, TIER_COL, WINNING_MODEL_COL, LabelRules
from promptweave.functions.text import strip
from promptweave.schemas import require_columns

DROP_RULE_COL = "drop_rule"

# In the order the rules are applied; a row counts under the first it fails.
DROP_REASONS = ("null_prompt", "blank_prompt", "no_decisive_winner", "unlisted_model")


def has_prompt(rules: LabelRules = LabelRules()) -> Column:
    return F.col(rules.prompt_col).isNotNull()


def has_visible_prompt(rules: LabelRules = LabelRules()) -> Column:
    return strip(rules.prompt_col) != ""


def has_decisive_winner(rules: LabelRules = LabelRules()) -> Column:
    """Tested on the raw value: a padded winner is unknown, not repaired."""
    return F.col(rules.winner_col).isin(*rules.decisive_winners)


def winning_model(rules: LabelRules = LabelRules()) -> Column:
    """Name of the winner; model names are stripped before the tier lookup."""
    won_by_a = strip(rules.winner_col) == F.lit(rules.model_a_wins)
    return F.when(won_by_a, strip(rules.model_a_col)).otherwise(strip(rules.model_b_col))


def tier_of(model: Column, rules: LabelRules = LabelRules()) -> Column:
    """Label of the first tier that lists the model (exact match), else NULL."""
    whens = [(model.isin(*tier.models), F.lit(tier.label)) for tier in rules.tiers]
    return reduce(lambda chain, w: chain.when(*w), whens[1:], F.when(*whens[0]))


def strip_text(df: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    return df.withColumns({c: strip(c) for c in rules.input_columns})


def clean_battles(df: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """Rows that pass every cleaning rule, text columns stripped.

    Separate filters rather than one rule number, so that the null and winner
    tests reach the scan.
    """
    require_columns(df, rules.input_columns, "battles")
    kept = (
        df.where(has_prompt(rules))
        .where(has_decisive_winner(rules))
        .where(has_visible_prompt(rules))
    )
    return strip_text(kept, rules)


def label_wins(df: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """Cleaned battles with ``winning_model`` and ``Target_Tier``; unlisted models go."""
    named = clean_battles(df, rules).withColumn(WINNING_MODEL_COL, winning_model(rules))
    labeled = named.withColumn(TIER_COL, tier_of(F.col(WINNING_MODEL_COL), rules))
    return labeled.where(F.col(TIER_COL).isNotNull())


def label_wins_by_lookup(df: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """The same rows through a join with the tier table, which is no larger than the rules."""
    named = clean_battles(df, rules).withColumn(WINNING_MODEL_COL, winning_model(rules))
    tiers = F.broadcast(rules.tier_table(df.sparkSession))
    return named.join(tiers, WINNING_MODEL_COL, "left").where(F.col(TIER_COL).isNotNull())


def labeled_prompts(
    df: DataFrame, rules: LabelRules = LabelRules(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(user_prompt, Target_Tier)``, preceded by key columns named in ``keep``.

    The prompt has that name whatever the rules call it in the input.
    """
    return label_wins(df, rules).select(*keep, F.col(rules.prompt_col).alias(PROMPT_COL), TIER_COL)


def drop_rule(rules: LabelRules = LabelRules()) -> Column:
    """1-based number of the first rule a row fails, 0 for rows that stay."""
    winner_ok = F.coalesce(has_decisive_winner(rules), F.lit(False))
    return (
        F.when(~has_prompt(rules), 1)
        .when(~has_visible_prompt(rules), 2)
        .when(~winner_ok, 3)
        .when(tier_of(winning_model(rules), rules).isNull(), 4)
        .otherwise(0)
    )


def _audit_counts(failed: Column) -> list[Column]:
    numbers = range(1, len(DROP_REASONS) + 1)
    return [F.count(F.lit(1)).alias("rows"), *[F.count_if(failed == n).alias(f"dropped_{n}") for n in numbers]]


def audit_steps(counts: DataFrame) -> DataFrame:
    """Rows before, dropped and left per rule, from one row of counts ``rows, dropped_1 ..``."""

    def step(n: int) -> Column:
        earlier = sum((F.col(f"dropped_{m}") for m in range(1, n)), F.lit(0).cast("long"))
        before = F.col("rows") - earlier
        dropped = F.col(f"dropped_{n}")
        share = F.coalesce(dropped * F.lit(100.0) / F.nullif(before, F.lit(0)), F.lit(0.0))
        return F.struct(
            F.lit(n).alias("rule"),
            F.lit(DROP_REASONS[n - 1]).alias("reason"),
            before.alias("rows_before"),
            dropped.alias("dropped"),
            share.alias("dropped_pct"),
            (before - dropped).alias("remaining"),
        )

    return counts.select(F.inline(F.array(*[step(n) for n in range(1, len(DROP_REASONS) + 1)])))


def drop_audit(df: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """Rows before, dropped and left per rule, from a single pass over the battles."""
    require_columns(df, rules.input_columns, "battles")
    failed = df.select(drop_rule(rules).alias(DROP_RULE_COL))
    return audit_steps(failed.agg(*_audit_counts(F.col(DROP_RULE_COL))))


def watched(df: DataFrame, rules: LabelRules = LabelRules()) -> tuple[DataFrame, Observation]:
    """The battles, and the counts of the audit as whatever reads them next takes them along.

    Write the result plainly and ask for ``counts.get`` after that: a global sort samples
    what it sorts and would count it twice, as may tasks run again after a lost executor.
    """
    require_columns(df, rules.input_columns, "battles")
    counts = Observation()
    marked = df.withColumn(DROP_RULE_COL, drop_rule(rules))
    return marked.observe(counts, *_audit_counts(F.col(DROP_RULE_COL))).drop(DROP_RULE_COL), counts


AUDIT_COUNTS = ("rows", *[f"dropped_{n}" for n in range(1, len(DROP_REASONS) + 1)])


def audit_table(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """The audit from counts that were taken along."""
    row = tuple(counts[c] for c in AUDIT_COUNTS)
    return audit_steps(spark.createDataFrame([row], ", ".join(f"{c} long" for c in AUDIT_COUNTS)))
