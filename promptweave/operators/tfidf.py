"""TF-IDF over unigrams and bigrams: fit with two aggregations, score inside the row."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweave.functions.constants import ENGLISH_STOP_WORDS
from promptweave.functions.terms import content_words_sql, terms_sql

MAX_FEATURES = 1000
NAMED_WORDS = 10_000
BLOCK_WORDS = 1 << 20  # codes of pairs times rows of a block fit 64 bits

_COUNTS = "term string, tf long, df long"
VOCABULARY_SCHEMA = "idx int, term string, tf long, df long, idf double"


@dataclass(frozen=True)
class Term:
    term: str
    tf: int
    df: int


@dataclass(frozen=True)
class Phrases:
    """The words of an SQL array expression and each pair of neighbours; an empty word has no neighbour.

    ``second_words``, if given, are those that a pair may end with.
    """

    words: str
    second_words: tuple[str, ...] | None = None


def _blocks(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Runs of rows with about ``BLOCK_WORDS`` words at most, one row at least."""
    offsets, start = lists.offsets.to_numpy(), 0
    while start < len(lists):
        end = int(np.searchsorted(offsets, offsets[start] + BLOCK_WORDS, "right")) - 1
        end = min(max(end, start + 1), start + BLOCK_WORDS, len(lists))
        yield lists.slice(start, end - start)
        start = end


def _summed(codes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each code with its number of occurrences and of rows that hold it."""
    marked = np.sort(codes * n_rows + rows)
    ordered = marked // n_rows
    firsts = np.flatnonzero(np.diff(ordered, prepend=-1))
    other_row = np.diff(marked, prepend=-1) != 0
    return ordered[firsts], np.diff(firsts, append=len(ordered)), np.add.reduceat(other_row.astype(np.int64), firsts)


def _block_counts(
    lists: pa.ListArray, pairs: bool, first_words: pa.Array | None = None, second_words: pa.Array | None = None
) -> Iterator[pa.RecordBatch]:
    """Counts of a block's words, then of its pairs, as ``(term, tf, df)``."""
    encoded = lists.flatten().dictionary_encode()
    names, codes = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    starts = np.ones(len(names), bool)
    if first_words is not None:
        first = pc.list_element(pc.split_pattern(names, " ", max_splits=1), 0)
        starts = pc.is_in(first, value_set=first_words).to_numpy(zero_copy_only=False)
    kept = starts[codes]
    found = [(codes[kept], rows[kept], lambda c: names.take(pa.array(c)))]
    if pairs:
        apart = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
        ends = apart
        if second_words is not None:
            ends = apart & pc.is_in(names, value_set=second_words).to_numpy(zero_copy_only=False)
        kept = (rows[1:] == rows[:-1]) & (starts & apart)[codes[:-1]] & ends[codes[1:]]
        both = codes[:-1][kept] * len(names) + codes[1:][kept]
        halves = lambda c: [names.take(pa.array(h)) for h in np.divmod(c, len(names))]
        found.append((both, rows[1:][kept], lambda c: pc.binary_join_element_wise(*halves(c), " ")))
    for taken, at, named in found:
        if len(taken):
            terms, tf, df = _summed(taken, at, len(lists))
            yield pa.RecordBatch.from_arrays([named(terms), pa.array(tf), pa.array(df)], ["term", "tf", "df"])


def _counter(pairs: bool, first_words: list[str] | None, second_words: tuple[str, ...] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = [w if w is None else pa.array(w, pa.string()) for w in (first_words, second_words)]
        for batch in batches:
            for block in _blocks(batch.column(0)):
                yield from _block_counts(block, pairs, *listed)

    return run


def _word_counts(df: DataFrame, words: str) -> DataFrame:
    return _added_up(df.select(F.expr(words).alias("words")).mapInArrow(_counter(False, None, None), _COUNTS))


def _added_up(counted: DataFrame) -> DataFrame:
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def counted_terms(df: DataFrame, terms: str | Phrases, first_words: list[str] | None = None) -> DataFrame:
    """``(term, tf, df)`` of an SQL array expression, or of its ``Phrases``, with one shuffle on the term.

    ``first_words`` keeps the terms that start with one of these words: in the
    tasks as long as the caller asks for few, else by a join with them.

    Texts are cut into words in the JVM. Tasks number the words of a block of rows,
    so that pairs are numbers as well, and sort these with their rows: occurrences
    and rows holding the term come out together, and a term becomes text once per block.
    Both sums are combined further before the shuffle, so a term of any frequency
    sends one row per map task.
    """
    pairs = isinstance(terms, Phrases)
    words, second_words = (terms.words, terms.second_words) if pairs else (terms, None)
    named = first_words is not None and len(first_words) <= NAMED_WORDS
    count = _counter(pairs, first_words if named else None, second_words)
    counted = df.select(F.expr(words).alias("words")).mapInArrow(count, _COUNTS)
    if first_words is not None and not named:
        listed = df.sparkSession.createDataFrame([(w,) for w in first_words], "word string")
        counted = counted.join(listed, F.substring_index("term", " ", 1) == F.col("word"), "left_semi")
    return _added_up(counted)


def _top_words(df: DataFrame, words: str, max_features: int) -> tuple[int, list[str], tuple[str, ...] | None]:
    """Number of rows, the ``max_features`` most frequent words, and all words as frequent as the last of these.

    Every row also holds one empty word, whose count is the number of rows. Where too many words
    share the last place, or too few are asked for to tell, the last result is None.
    """
    order = (F.col("term") != "", F.desc("tf"), F.col("term"))
    counts = _word_counts(df, f"concat(array(''), {words})").orderBy(*order)
    top = [(r["term"], r["tf"]) for r in counts.limit(2 * max_features + 1).collect()]
    if not top:
        return 0, [], None
    (_, n), found = top[0], top[1:]
    frequent = [w for w, _ in found[:max_features]]
    if len(found) <= max_features or len(found) > NAMED_WORDS:
        return n, frequent, None
    least = found[max_features - 1][1]
    if len(found) == 2 * max_features and found[-1][1] >= least:
        return n, frequent, None
    return n, frequent, tuple(w for w, tf in found if tf >= least)


def fit_tfidf(
    df: DataFrame,
    text_col: str = "user_prompt",
    out: str = "tfidf",
    max_features: int = MAX_FEATURES,
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
) -> TfidfModel:
    """Choose the ``max_features`` most frequent terms and weigh them.

    Bigrams outnumber words by orders of magnitude, so words are counted first.
    A bigram is never more frequent than its first word and sorts after it, so
    one that makes the cut starts with one of the ``max_features`` first words.
    Nor is it more frequent than its second word, which has to be as frequent as the
    last of these words. The second pass counts only such terms, which loses nothing.
    Twice ``max_features`` words and the vocabulary are what reaches the driver.

    Ties in the cut go to the alphabetically first term.
    """
    stop = tuple(stop_words)
    words = content_words_sql(text_col, stop)
    n_docs, frequent, as_frequent = _top_words(df, words, max_features)
    if not frequent:
        raise ValueError("no terms to fit: the texts hold only stop words or nothing")
    top = counted_terms(df, Phrases(words, as_frequent), frequent).orderBy(F.desc("tf"), "term").limit(max_features).collect()
    chosen = sorted((Term(r["term"], r["tf"], r["df"]) for r in top), key=lambda t: t.term)
    return TfidfModel.build(df.sparkSession, chosen, n_docs, text_col, out, stop)


class TfidfModel:
    """A fitted vocabulary and the pipeline that scores text with it."""

    def __init__(self, vocabulary: list[Term], n_docs: int, out: str, pipeline: PipelineModel):
        self.vocabulary = vocabulary
        self.n_docs = n_docs
        self.out = out
        self.pipeline = pipeline

    @classmethod
    def build(
        cls,
        spark: SparkSession,
        vocabulary: list[Term],
        n_docs: int,
        text_col: str,
        out: str,
        stop_words: Iterable[str],
    ) -> TfidfModel:
        terms, counts, weighted = (f"{out}__{s}" for s in ("terms", "counts", "weighted"))
        names = [t.term for t in vocabulary]
        idf = Vectors.dense([smooth_idf(n_docs, t.df) for t in vocabulary])
        split = f"SELECT *, {terms_sql(text_col, stop_words)} AS {terms} FROM __THIS__"
        tidy = f"SELECT * EXCEPT ({terms}, {counts}, {weighted}) FROM __THIS__"
        stages = [
            SQLTransformer(statement=split),
            CountVectorizerModel.from_vocabulary(names, inputCol=terms, outputCol=counts),
            ElementwiseProduct(scalingVec=idf, inputCol=counts, outputCol=weighted),
            Normalizer(p=2.0, inputCol=weighted, outputCol=out),
            SQLTransformer(statement=tidy),
        ]
        return cls(vocabulary, n_docs, out, PipelineModel(stages))

    @property
    def terms(self) -> list[str]:
        """Term of each vector position, in alphabetical order."""
        return [t.term for t in self.vocabulary]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the L2-normalised vector; batch or streaming, row by row."""
        return self.pipeline.transform(df)

    def vocabulary_table(self, spark: SparkSession) -> DataFrame:
        """At most ``max_features`` rows ``(idx, term, tf, df, idf)``."""
        rows = [
            (i, t.term, t.tf, t.df, smooth_idf(self.n_docs, t.df))
            for i, t in enumerate(self.vocabulary)
        ]
        return spark.createDataFrame(rows, VOCABULARY_SCHEMA)

    def fit_sparsity(self) -> float:
        """Share of zero cells in the fitted corpus; each df is a column's non-zero cells."""
        cells = self.n_docs * len(self.vocabulary)
        return 1.0 - sum(t.df for t in self.vocabulary) / cells

    def save(self, spark: SparkSession, path: str) -> None:
        """Pipeline for any Spark program, vocabulary as Parquet."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        table = self.vocabulary_table(spark).withColumns(
            {"n_docs": F.lit(self.n_docs).cast("long"), "out": F.lit(self.out)}
        )
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfModel:
        rows = spark.read.parquet(f"{path}/vocabulary").orderBy("idx").collect()
        vocabulary = [Term(r["term"], r["tf"], r["df"]) for r in rows]
        pipeline = PipelineModel.load(f"{path}/pipeline")
        return cls(vocabulary, rows[0]["n_docs"], rows[0]["out"], pipeline)


def smooth_idf(n_docs: int, df: int) -> float:
    """``ln((1 + n) / (1 + df)) + 1``: as if one more row held every term."""
    return math.log((1 + n_docs) / (1 + df)) + 1.0


def stored_cells(vector_col: str) -> Column:
    """The cells a vector stores, as ``(idx, weight)``; a sparse one does not store its zeros."""
    vector = F.unwrap_udt(vector_col)
    values = vector["values"]
    every = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1))
    places = F.coalesce(vector["indices"], every)
    return F.zip_with(places, values, lambda i, w: F.struct(i.alias("idx"), w.alias("weight")))


def long_form(df: DataFrame, model: TfidfModel, id_col: str) -> DataFrame:
    """Non-zero cells as ``(id, term, weight)``; the term lookup is the vocabulary."""
    cells = df.select(id_col, F.inline(stored_cells(model.out)))
    names = model.vocabulary_table(df.sparkSession).select("idx", "term")
    return cells.where("weight != 0").join(names, "idx").select(id_col, "term", "weight")


def sparsity(df: DataFrame, vector_col: str, width: int) -> DataFrame:
    """Share of zero cells in any scored table, as one row."""
    nonzero = F.size(F.filter(F.unwrap_udt(vector_col)["values"], lambda w: w != 0))
    rows = df.agg(F.count("*").alias("rows"), F.sum(nonzero).alias("nonzero"))
    cells = F.nullif(F.col("rows") * F.lit(width), F.lit(0))
    return rows.withColumn("sparsity", F.lit(1.0) - F.col("nonzero") / cells)


def widen(df: DataFrame, model: TfidfModel, prefix: str = "tfidf_") -> DataFrame:
    """Replace the vector by one double column per term. For export only."""
    listed = df.withColumn("__cells", vector_to_array(model.out))
    others = [f"`{c}`" for c in df.columns if c != model.out]
    cells = [f"__cells[{i}] AS `{prefix}{term}`" for i, term in enumerate(model.terms)]
    return listed.selectExpr(*others, *cells)
