"""Quality of documents: histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded, documented number of labelled
rows; statistics of them and the scores of all documents are computed where the
documents are. A fitted model is four small arrays, walked level by level for
all rows of a batch and all trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = (
    "log_bytes", "lower", "upper", "digits", "blank", "commas_stops", "symbols", "bars",
    "exclamations", "newlines", "non_ascii", "byte_entropy", "word_length", "word_length_spread",
    "distinct_words", "top_word", "upper_words", "symbol_ended_words", "words_per_line",
    "repeated_lines", "ended_lines", "longest_word",
)
TRAIN_ROWS = 20_000
REJECT_BELOW = 0.7


def _mask(characters: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(characters.encode())] = True
    return mask


_CLASSES = np.stack(
    [
        _mask("abcdefghijklmnopqrstuvwxyz"),
        _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _mask("0123456789"),
        _mask(" \t"),
        _mask(",.;:'\"()-?"),
        _mask("#$%&*+/<=>@[\\]^_`{}~"),
        _mask("|"),
        _mask("!"),
        _mask("\r\n"),
        np.arange(256) >= 128,
    ]
).astype(float)


def _statistics(text: str) -> list[float]:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return [0.0] * len(FEATURES)
    shares = np.bincount(data, minlength=256) / len(data)
    present = shares[shares > 0]
    entropy = float(-(present * np.log2(present)).sum())
    words = text.split()
    lines = [line for line in text.splitlines() if line.strip()]
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    upper = sum(n for w, n in counts.items() if len(w) > 1 and w.isupper())
    ended = sum(n for w, n in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:'\")?-")
    stops = sum(line.rstrip()[-1] in ".!?:;\"'" for line in lines)
    return [
        float(np.log1p(len(data))),
        *(_CLASSES @ shares),
        entropy,
        float(lengths.mean()),
        float(lengths.std()),
        len(counts) / n_words,
        top / n_words,
        upper / n_words,
        ended / n_words,
        float(np.log1p(n_words / n_lines)),
        1.0 - len(set(lines)) / n_lines if lines else 0.0,
        stops / n_lines,
        float(np.log1p(lengths.max())),
    ]


def document_statistics(texts: Iterable[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text; a null or empty text has zeros only."""
    rows = [_statistics(t) if isinstance(t, str) else [0.0] * len(FEATURES) for t in texts]
    return np.array(rows, float).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class BoostedTrees:
    """Perfect binary trees as arrays ``(tree, node)``; node i has children 2i+1 and 2i+2.

    A node that is not split has an infinite threshold, so every row goes left
    and meets the same value below.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @property
    def tells_apart(self) -> bool:
        """Whether any node is split, so that scores of documents can differ."""
        return bool(np.isfinite(self.threshold).any())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees, nodes = self.feature.shape
        raw = np.full(len(x), self.base)
        if trees and len(x):
            depth = (nodes + 1).bit_length() - 2
            offset = np.arange(trees) * nodes
            feature, threshold = self.feature.ravel(), self.threshold.ravel()
            rows = np.arange(len(x))[:, None]
            at = np.zeros((len(x), trees), np.int64)
            for _ in range(depth):
                where = at + offset
                at = 2 * at + 1 + (x[rows, feature[where]] > threshold[where])
            raw = raw + self.value.ravel()[at + offset].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-raw))


def _best_splits(hist: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, ...]:
    """Per node the best (gain, feature, bin) of a histogram (node, feature, bin, [grad, hess])."""
    left = hist.cumsum(axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    strength = lambda s: s[..., 0] ** 2 / (s[..., 1] + ridge)
    gain = strength(left) + strength(right) - strength(total)
    gain[(left[..., 1] < least) | (right[..., 1] < least)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), best], best // hist.shape[2], best % hist.shape[2]


def fit_boosted_trees(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 1.0,
    least: float = 3.0,
) -> BoostedTrees:
    """Boost the logistic loss; splits are found on histograms of at most ``bins`` quantiles.

    Without rows the score is 1/2, with one label only it is near that label.
    """
    nodes = 2 ** (depth + 1) - 1
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1.0 - share)))
    empty = BoostedTrees(base, np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, nodes)))
    if not len(y) or y.min() == y.max():
        return empty
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    cuts = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    n_features = x.shape[1]
    raw = np.full(len(y), base)
    feature = np.zeros((trees, nodes), int)
    threshold = np.full((trees, nodes), np.inf)
    value = np.zeros((trees, nodes))
    for tree in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        grad, hess = p - y, p * (1.0 - p)
        at = np.zeros(len(y), int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            cell = (local[:, None] * n_features + np.arange(n_features)) * bins + binned
            size = width * n_features * bins
            hist = np.stack(
                [np.bincount(cell.ravel(), np.repeat(w, n_features), size) for w in (grad, hess)], axis=-1
            ).reshape(width, n_features, bins, 2)
            gain, which, cut = _best_splits(hist, ridge, least)
            for node in np.flatnonzero(gain > 1e-6):
                feature[tree, first + node] = which[node]
                threshold[tree, first + node] = cuts[which[node]][cut[node]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[tree, at]] > threshold[tree, at])
        leaves = np.arange(nodes - 2**depth, nodes)
        g, h = (np.bincount(at, w, nodes)[leaves] for w in (grad, hess))
        value[tree, leaves] = -rate * g / (h + ridge)
        raw += value[tree, at]
    return BoostedTrees(base, feature, threshold, value)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows whose labels are never learned from; false for a null id."""
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series(list(document_statistics(texts)), dtype=object)


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> BoostedTrees:
    """Learn from at most ``train_rows`` labelled documents that are not held out.

    The rows are those of the smallest hashes of their ids, whatever the order
    or partitioning of the tables. A label is 1 if the labels of a document say
    so at least as often as not; null ids and labels are left out.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    votes = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("_label"))
    sample = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = (
        known.select("doc_id", "_label", _statistics_of("text").alias("_x"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_x")
        .limit(train_rows)
        .collect()
    )
    x = np.array([r["_x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit_boosted_trees(x, np.array([r["_label"] for r in rows], float))


def quality_score(model: BoostedTrees, text_col: str = "text") -> Column:
    """Score of a text column; batches of rows, no shuffle."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(document_statistics(texts)))

    return score(F.col(text_col))


def score_documents(docs: DataFrame, model: BoostedTrees, reject_below: float = REJECT_BELOW) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    A null or empty text has the score of zero statistics; repeated rows are
    scored alike; an empty table gives an empty one. Other columns are ignored.
    """
    scored = docs.select("doc_id", quality_score(model).alias("score"))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= reject_below).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, model: BoostedTrees, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The documents that are not rejected, with the columns they came with.

    A model that found nothing in its labels to tell documents apart rejects none.
    """
    if not model.tells_apart:
        return docs
    return docs.withColumn("_quality", quality_score(model)).where(F.col("_quality") >= reject_below).drop("_quality")
