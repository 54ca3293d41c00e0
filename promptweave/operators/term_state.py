"""Stored term counts that grow by batches, so that a refit does not scan old texts again.

A state is a folder. Every batch of texts leaves its counts ``(term, tf, df)`` there, all
terms, under its own name; the empty term's ``tf`` is the number of texts. Counts add up,
so fitting sums them over batches and chooses the vocabulary from the sums: the model is
that of a fit on all texts at once. A batch that is added again replaces itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweave.functions.constants import ENGLISH_STOP_WORDS
from promptweave.functions.terms import content_words_sql
from promptweave.operators.tfidf import MAX_FEATURES, Phrases, Term, TfidfModel, counted_terms

COUNTS = "term string, tf long, df long"


class TermState:
    """Term counts of the batches in a folder."""

    def __init__(self, spark: SparkSession, path: str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS):
        """Open a folder, new or not; one made with other stop words is an error."""
        self.spark = spark
        self.path = path.rstrip("/")
        self.stop_words = tuple(stop_words)
        rules = json.dumps(sorted(set(self.stop_words)))
        try:
            known = spark.read.text(f"{self.path}/rules").first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            known = None
        if known is None:
            spark.createDataFrame([(rules,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/rules")
        elif known["value"] != rules:
            raise ValueError(f"{path} was counted with other stop words")

    def add(self, texts: DataFrame, batch: str, text_col: str = "user_prompt") -> None:
        """Count the terms of a batch of texts; the same ``batch`` replaces its earlier counts."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or batch[0] in "._":
            raise ValueError(f"batch {batch!r} is no plain name")
        terms = Phrases(f"concat(array(''), {content_words_sql(text_col, self.stop_words)})")
        counted_terms(texts, terms).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")

    def counts(self) -> DataFrame:
        """``(term, tf, df)`` over all batches; none have no rows."""
        try:
            found = self.spark.read.schema(COUNTS).parquet(f"{self.path}/batches/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COUNTS)
        return found.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))

    def compact(self, path: str) -> TermState:
        """The same counts as one batch of a new state."""
        merged = TermState(self.spark, path, self.stop_words)
        self.counts().write.mode("overwrite").parquet(f"{merged.path}/batches/merged")
        return merged

    def fit(self, out: str = "tfidf", max_features: int = MAX_FEATURES, text_col: str = "user_prompt") -> TfidfModel:
        """The model of all texts counted; ties in the cut go to the alphabetically first term."""
        order = (F.col("term") != "", F.desc("tf"), F.col("term"))
        top = self.counts().orderBy(*order).limit(max_features + 1).collect()
        if len(top) < 2:
            raise ValueError("no terms to fit: the texts hold only stop words or nothing")
        chosen = sorted((Term(r["term"], r["tf"], r["df"]) for r in top[1:]), key=lambda t: t.term)
        return TfidfModel.build(self.spark, chosen, top[0]["tf"], text_col, out, self.stop_words)
