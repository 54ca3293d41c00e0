"""Few dimensions for many terms: truncated SVD of sparse vectors, and clusters in its space.

The leading right singular vectors are found by subspace iteration from a random start:
a pass multiplies ``X^T X`` with a thin matrix, row block by row block in the tasks, and
sums the products per term before and after one shuffle. What the driver holds is that
matrix, terms by dimensions, never rows. Projection is row by row, clustering is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweave.operators.tfidf import stored_cells

OVERSAMPLE = 10
PASSES = 6
SEED = 17
_BLOCK = 512
_SQUARES = -1  # the row that sums squares up goes under this term


def _block(part: pa.RecordBatch, width: int) -> np.ndarray:
    """The rows of a batch of cells as a dense block."""
    lists = part.column("cells")
    cells = lists.flatten()
    rows = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    dense = np.zeros((part.num_rows, width))
    dense[rows, cells.field(0).to_numpy()] = cells.field(1).to_numpy()
    return dense


def _products(width: int, basis: np.ndarray):
    """Rows to one row per term with its part of ``X^T X basis``."""
    names = [f"c{j}" for j in range(basis.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(basis.shape), 0.0
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                dense = _block(batch.slice(start, _BLOCK), width)
                total += dense.T @ (dense @ basis)
                squares += float((dense * dense).sum())
        if squares:
            terms = np.concatenate([np.arange(width), [_SQUARES]]).astype(np.int32)
            values = np.vstack([total, np.full(basis.shape[1], squares)])
            yield pa.RecordBatch.from_arrays([pa.array(terms), *[pa.array(v) for v in values.T]], ["term", *names])

    return run


def _gram_times(cells: DataFrame, width: int, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """``X^T X basis`` and the sum of all squares, from one pass over the rows."""
    names = [f"c{j}" for j in range(basis.shape[1])]
    parts = cells.mapInArrow(_products(width, basis), "term int, " + ", ".join(f"{n} double" for n in names))
    found = np.zeros(basis.shape)
    squares = 0.0
    for r in parts.groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).collect():
        if r["term"] == _SQUARES:
            squares = r[1]
        else:
            found[r["term"]] = r[1:]
    return found, squares


@dataclass(frozen=True)
class TermSpace:
    """Directions (terms by dimensions), their singular values, and the sum of squares of all cells."""

    directions: np.ndarray
    singular: np.ndarray
    squares: float

    @property
    def shares(self) -> np.ndarray:
        """Share of the squares that each direction explains."""
        return self.singular**2 / self.squares

    def project(self, df: DataFrame, vector_col: str, out: str = "reduced") -> DataFrame:
        """Adds the coordinates of each row's vector as an array; batch or streaming."""
        directions = self.directions

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def coordinates(places: pd.Series, weights: pd.Series) -> pd.Series:
            return pd.Series([(w[:, None] * directions[p]).sum(axis=0) for p, w in zip(places, weights, strict=True)])

        cells = stored_cells(vector_col)
        return df.withColumn(out, coordinates(cells["idx"], cells["weight"]))


def fit_term_space(
    df: DataFrame, vector_col: str, width: int, dimensions: int, passes: int = PASSES, seed: int = SEED
) -> TermSpace:
    """Truncated SVD, not centred, of the vectors of a scored table that is cheap to read again.

    Takes ``passes`` passes and one for the values. ``dimensions`` beyond the rank have
    singular value zero; a table without any non-zero cell is an error. Each direction
    is turned so that its largest part is positive.
    """
    cells = df.select(stored_cells(vector_col).alias("cells"))
    size = min(width, dimensions + OVERSAMPLE)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    for _ in range(passes):
        product, _ = _gram_times(cells, width, basis)
        basis = np.linalg.qr(product)[0]
    product, squares = _gram_times(cells, width, basis)
    if not squares:
        raise ValueError("no non-zero cells to fit")
    values, turn = np.linalg.eigh(basis.T @ product)
    order = np.argsort(-values)[: min(dimensions, size)]
    directions = basis @ turn[:, order]
    largest = directions[np.abs(directions).argmax(axis=0), np.arange(len(order))]
    directions = directions * np.where(largest < 0, -1.0, 1.0)
    return TermSpace(directions, np.sqrt(np.maximum(values[order], 0.0)), squares)


def fit_clusters(reduced: DataFrame, clusters: int, column: str = "reduced", seed: int = SEED) -> KMeansModel:
    """Spark's k-means in the reduced space."""
    vectors = reduced.select(array_to_vector(column).alias("features"))
    return KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)


def with_cluster(reduced: DataFrame, model: KMeansModel, column: str = "reduced") -> DataFrame:
    """Adds each row's ``cluster``."""
    columns = [c for c in reduced.columns if c != "features"]
    return model.transform(reduced.select(*columns, array_to_vector(column).alias("features"))).drop("features")
