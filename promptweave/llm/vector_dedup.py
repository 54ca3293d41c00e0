"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

A hash turns a vector by three rounds of random signs and the fast Hadamard transform
and takes the signed axis it lies closest to. A table joins a few hashes to one
bucket; a vector is stored in its own bucket and looks into the next likely ones too.
Pairs that meet in any table, and whose 64 sign bits do not rule them out, are verified
by their cosine in double precision.

Groups of copies are not compared pair by pair. Vectors that share the buckets of two
tables with many others are gathered around the mean of these, if they are so close to
it that by the triangle inequality all of them are linked with each other. Such a ball
goes through the buckets as one cell. Two cells are decided by the angle between their
centres and their radii where that suffices, else member by member against the other's
centre, and only where that too is open by single pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweave.llm.common import connected_components, join_checked
from promptweave.session import scratch_path

MIN_COSINE = 0.93
PROBES = 4
RECALL = 0.998
BUCKET_ROWS = 8
BALL_ROWS = 16
SKETCH_BITS = 22
LEAST_SIZE = 64
SEED = 11
_MARGIN = 1e-6
_LOOKED_AT = {1: 8, 2: 6, 3: 4}
_BLOCK = 2048


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; a row's length is a power of two."""
    rows, size = x.shape
    step = 1
    while step < size:
        parts = x.reshape(rows, size // (2 * step), 2, step)
        x = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(rows, size)
        step *= 2
    return x


@lru_cache(maxsize=1024)
def _signs(size: int, number: int) -> np.ndarray:
    return np.random.default_rng([SEED, size, number]).choice([-1.0, 1.0], (3, size))


def _turned(x: np.ndarray, number: int) -> np.ndarray:
    """Unit rows under rotation ``number``, which is the same wherever it is made."""
    for signs in _signs(x.shape[1], number):
        x = hadamard(x * signs) / math.sqrt(x.shape[1])
    return x


def _turning_size(size: int) -> int:
    return max(LEAST_SIZE, 1 << (size - 1).bit_length())


def _padded(vectors: np.ndarray) -> np.ndarray:
    """Unit rows, filled up with zeros to a power of two, to one that leaves room to turn in."""
    size = _turning_size(vectors.shape[1])
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.pad(unit, ((0, 0), (0, size - vectors.shape[1])))


def bucket_codes(unit: np.ndarray, table: int, hashes: int, probes: int = PROBES) -> np.ndarray:
    """Per row its own bucket of a table, then the ``probes`` next likely ones, -1 where there are no more.

    How likely a bucket is follows from what its axes fall short of the closest ones.
    """
    axes = 2 * unit.shape[1]
    looked = min(_LOOKED_AT.get(hashes, 3), unit.shape[1])
    places, short = [], []
    for h in range(hashes):
        turned = _turned(unit, table * 16 + h)
        far = np.abs(turned)
        best = np.argsort(-far, axis=1, kind="stable")[:, :looked]
        length = np.take_along_axis(far, best, 1)
        places.append(2 * best + (np.take_along_axis(turned, best, 1) < 0))
        short.append(length[:, :1] - length)
    ways = list(product(range(looked), repeat=hashes))
    lacks = np.stack([sum(short[h][:, w[h]] for h in range(hashes)) for w in ways], axis=1)
    codes = np.stack([sum(places[h][:, w[h]] * axes**h for h in range(hashes)) for w in ways], axis=1)
    chosen = np.argsort(lacks, axis=1, kind="stable")[:, : probes + 1]
    found = np.take_along_axis(codes, chosen, 1)
    return np.pad(found, ((0, 0), (0, probes + 1 - found.shape[1])), constant_values=-1)


def tables_for(size: int, hashes: int, cosine: float = MIN_COSINE, recall: float = RECALL) -> int:
    """Number of tables in which pairs at the threshold meet with probability ``recall``.

    Measured on 2,000 random pairs at that cosine, not on the data.
    """
    rng = np.random.default_rng([SEED, size, hashes])
    x, y = rng.normal(size=(2, 2000, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if size > 1:
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        y = cosine * x + math.sqrt(1 - cosine * cosine) * y
    else:
        y = x
    a, b = (bucket_codes(_padded(v), 0, hashes) for v in (x, y))
    met = ((a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)).mean()
    return 1 if met >= recall else max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(max(met, 0.02), 0.999))))


def _hashed(tables: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(start, _BLOCK)
                lists = part.column(2)
                values, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                sizes = np.diff(bounds)
                homes = np.empty((part.num_rows, tables), np.int64)
                probes = np.empty((part.num_rows, tables * PROBES), np.int64)
                sketch = np.empty(part.num_rows, np.int64)
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    unit = _padded(values[bounds[rows][:, None] + np.arange(size)])
                    for t in range(tables):
                        codes = bucket_codes(unit, t, hashes)
                        codes = np.where(codes < 0, -1, codes * tables + t)
                        homes[rows, t] = codes[:, 0]
                        probes[rows, t * PROBES : (t + 1) * PROBES] = codes[:, 1:]
                    bits = _turned(unit, 1 << 20)[:, :64] > 0
                    sketch[rows] = np.packbits(bits, axis=1).view(">i8")[:, 0]

                def listed(codes: np.ndarray) -> pa.Array:
                    ends = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel()))

                columns = [*part.columns, pa.array(sizes.astype(np.int32)), listed(homes), listed(probes), pa.array(sketch)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "dim", "homes", "probes", "sketch"])

    return run


@F.arrow_udf(T.DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine of two columns of vectors of equal length in each row."""
    x, y = a.flatten().to_numpy(), b.flatten().to_numpy()
    starts = a.offsets.to_numpy()[:-1] - a.offsets[0].as_py()
    if not len(starts):
        return pa.array([], pa.float64())
    dot, xx, yy = (np.add.reduceat(v, starts) for v in (x * y, x * x, y * y))
    return pa.array(dot / (np.sqrt(xx) * np.sqrt(yy)))


def _vectors(df: DataFrame) -> DataFrame:
    """All rows with a key of their own; ``vector`` is null for those that link with nothing.

    Vectors are scaled by a power of two, which changes no cosine and keeps squares in range.
    """
    given = F.col("embedding").cast("array<double>")
    fit = F.forall("given", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    largest = F.array_max(F.transform("given", F.abs))
    scale = F.pow(F.lit(2.0), -F.floor(F.log2(F.col("largest"))))
    rows = df.select("vec_id", "label", given.alias("given"), F.monotonically_increasing_id().alias("v"))
    sized = rows.withColumn("largest", F.when(F.col("label").isNotNull() & fit, largest))
    vector = F.when(F.col("largest") > 0, F.transform("given", lambda x: x * scale))
    return _kept(sized.select("v", "vec_id", "label", vector.alias("vector")), "vectors")


def _balls(hashed: DataFrame, tables: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """Members ``(v, cell)`` of the balls, and the balls ``(cell, label, dim, center, radius, size)``.

    A ball's members lie within ``reach`` of its centre; a vector that several would
    take goes to the one made of the largest group.
    """
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(tables - 1)),
        lambda t: F.xxhash64("label", "dim", t, F.get("homes", t), F.get("homes", (t + 1) % tables)),
    )
    fine = hashed.select("v", F.explode(F.array_distinct(keys)).alias("key"))
    groups = _kept(fine.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= BALL_ROWS), "groups")
    narrow = join_checked(fine, groups, ["key"], "inner")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("vector", lambda x: x / F.col("norm"))
    near = narrow.join(hashed.select("v", "label", "dim", "vector"), "v")
    near = _kept(near.withColumn("norm", norm).withColumn("vector", unit).drop("norm"), "near")
    by = ["key", "label", "dim"]
    means = near.groupBy(*by).agg(Summarizer.mean(array_to_vector("vector")).alias("mean"))
    centers = _kept(means.select(*by, vector_to_array("mean").alias("center")), "centers")
    angle = F.acos(F.least(F.lit(1.0), _cosine("vector", "center")))
    # Opposite copies may cancel out; a centre of zeros gives NaN, which is beyond any reach.
    close = join_checked(near, centers, by, "inner").withColumn("angle", angle).where(F.col("angle") <= reach)
    best = close.groupBy("v").agg(F.max(F.struct("n", "key", "label", "dim", "angle")).alias("b")).select("v", "b.*")
    best = _kept(best, "members")
    made = best.groupBy(*by).agg(F.min("v").alias("cell"), F.max("angle").alias("radius"), F.count("*").alias("size"))
    balls = _kept(join_checked(made.where("size > 1"), centers, by, "inner"), "balls")
    members = join_checked(best.select("v", *by), balls.select(*by, "cell"), by, "inner").select("v", "cell")
    return _kept(members, "in-balls"), balls.select("cell", "label", "dim", "center", "radius", "size")


def _candidates(hashed: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct pairs of cells ``(a, b)`` that meet: one's own bucket is among those the other looks into."""
    rows = hashed.select("v", "label", "dim", "homes", "probes", "sketch").join(members, "v", "left")
    codes = F.concat(
        F.transform("homes", lambda c: F.struct(c.alias("code"), F.lit(True).alias("home"))),
        F.transform("probes", lambda c: F.struct(c.alias("code"), F.lit(False).alias("home"))),
    )
    looked = rows.select(
        F.coalesce("cell", "v").alias("cell"),
        # A ball reaches further than its centre, so only single vectors are ruled out by bits.
        F.when(F.col("cell").isNull(), F.col("sketch")).alias("sketch"),
        "label",
        "dim",
        F.explode(codes).alias("c"),
    ).where("c.code >= 0")
    bucket = F.xxhash64("label", "dim", "c.code").alias("bucket")
    met = looked.groupBy(bucket, "cell", "sketch").agg(F.max("c.home").alias("home"))
    met = _kept(met, "buckets")
    own = met.where("home").select("bucket", F.col("cell").alias("a"), F.col("sketch").alias("sketch_a"))
    pairs = own.join(met, "bucket").where("a <> cell")
    alike = F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch"))) <= SKETCH_BITS
    pairs = pairs.where(F.coalesce(alike, F.lit(True)))
    return pairs.select(F.least("a", "cell").alias("a"), F.greatest("a", "cell").alias("b")).distinct()


def _verdict(angle: Column, radius: Column, most: float) -> Column:
    """True if all pairs are linked, False if none, null if that is open."""
    return F.when(angle + radius <= most - _MARGIN, True).when(angle - radius > most + _MARGIN, False)


def _links(hashed: DataFrame, members: DataFrame, balls: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Links to be added up: ``(v, n)`` of vectors, and edges ``(u, v)`` that join all that are linked."""
    most = math.acos(cosine)
    single = hashed.join(members, "v", "left_anti").select(
        F.col("v").alias("cell"),
        "label",
        "dim",
        F.col("vector").alias("center"),
        F.lit(0.0).alias("radius"),
        F.lit(1).cast("long").alias("size"),
    )
    cells = single.union(balls)

    def side(name: str) -> DataFrame:
        return cells.select(*[F.col(c).alias(name if c == "cell" else f"{c}_{name}") for c in cells.columns])

    pairs = _candidates(hashed, members).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where("label_a = label_b AND dim_a = dim_b").withColumn("cosine", _cosine("center_a", "center_b"))
    radii = F.col("radius_a") + F.col("radius_b")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine"))))
    linked = F.when(radii == 0, F.col("cosine") >= cosine).otherwise(_verdict(angle, radii, most))
    met = pairs.withColumn("linked", linked).where("linked IS NULL OR linked")
    met = _kept(met.select("a", "b", "size_a", "size_b", "radius_b", "linked"), "cell-pairs")
    whole = met.where("linked")
    per_cell = whole.select(F.col("a").alias("cell"), F.col("size_b").alias("n")).union(
        whole.select("b", F.col("size_a"))
    )
    edges = whole.select(F.col("a").alias("u"), F.col("b").alias("v"))

    inside = hashed.select("v", "vector").join(members, "v", "left").withColumn("cell", F.coalesce("cell", "v"))
    open_pairs = met.where("linked IS NULL")
    one = open_pairs.join(inside.select(F.col("cell").alias("a"), F.col("v").alias("x"), "vector"), "a")
    one = one.join(side("b").select("b", "center_b"), "b")
    one = one.withColumn("cosine", _cosine("vector", "center_b"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine"))))
    linked = F.when(F.col("radius_b") == 0, F.col("cosine") >= cosine).otherwise(_verdict(angle, F.col("radius_b"), most))
    one = one.withColumn("linked", linked).where("linked IS NULL OR linked")
    one = _kept(one.select("x", "vector", "b", "size_b", "linked"), "member-pairs")
    sure = one.where("linked")
    per_cell = per_cell.union(sure.select(F.col("b").alias("cell"), F.lit(1).cast("long").alias("n")))
    per_vector = sure.select(F.col("x").alias("v"), F.col("size_b").alias("n"))
    edges = edges.union(sure.select("x", "b"))

    last = one.where("linked IS NULL").withColumnRenamed("vector", "vector_x")
    last = last.join(inside.select(F.col("cell").alias("b"), F.col("v").alias("y"), "vector"), "b")
    last = _kept(last.where(_cosine("vector_x", "vector") >= cosine).select("x", "y"), "single-pairs")
    each = last.select(F.explode(F.array("x", "y")).alias("v"), F.lit(1).cast("long").alias("n"))
    per_vector = per_vector.union(each)
    edges = edges.union(last)

    summed = per_cell.groupBy("cell").agg(F.sum("n").alias("n"))
    of_members = members.join(summed, "cell").select("v", "n")
    of_singles = summed.join(members.select(F.col("v").alias("cell")), "cell", "left_anti").select(F.col("cell").alias("v"), "n")
    sizes = balls.select("cell", (F.col("size") - 1).alias("n"))
    own = join_checked(members, sizes, ["cell"], "inner").select("v", "n")
    links = per_vector.union(of_members).union(of_singles).union(own).groupBy("v").agg(F.sum("n").alias("n"))
    return links, edges.union(members.where("v <> cell").select(F.col("v").alias("u"), F.col("cell").alias("v")))


def vector_components(df: DataFrame, cosine: float = MIN_COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``(vec_id, embedding, label)``.

    Vectors of one label and length are linked from ``cosine`` (above 0.5) on. A null label,
    a null, empty or zero vector and one with components that are null or not finite
    have no links. Rows are told apart even where they share a vec_id or have none: a
    component's id is the smallest vec_id in it, a row without one is not kept. An
    empty table gives no rows, columns of other names play no part.
    """
    rows = _vectors(df)
    fit = rows.where("vector IS NOT NULL")
    count, size = fit.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.isnotnull("vec_id").alias("kept"),
        )
    axes = 2 * _turning_size(size)
    # More buckets than rows by far would only split pairs; 62 bits hold all codes.
    hashes = max(1, min(math.ceil(math.log(max(1, count / BUCKET_ROWS), axes)), int(40 / math.log2(axes))))
    tables = tables_for(size, hashes, cosine)
    schema = "v long, label int, vector array<double>, dim int, homes array<long>, probes array<long>, sketch long"
    schema = schema.replace("label int", f"label {rows.schema['label'].dataType.simpleString()}")
    hashed = _kept(fit.select("v", "label", "vector").mapInArrow(_hashed(tables, hashes), schema), "hashed")
    members, balls = _balls(hashed, tables, math.acos(cosine) / 2 - _MARGIN)
    links, edges = _links(hashed, members, balls, cosine)
    found = connected_components(edges).withColumnsRenamed({"node": "v"})
    ids = rows.select("v", "vec_id").join(found, "v")
    lowest = ids.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = ids.join(lowest, "root").select("v", "component_id")
    out = rows.select("v", "vec_id").join(links, "v", "left").join(named, "v", "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
