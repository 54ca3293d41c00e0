"""Near duplicates by SimHash: 64-bit fingerprints, linked exactly through vantage-point trees.

A tree splits the space of fingerprints by their Hamming distance to a vantage
point. By the triangle inequality two fingerprints within ``LINK_BITS`` bits of
each other have distances to it that differ by no more than that, so a point
that lies inside the radius, but that close to it, is handed to the outer side
as well, and every pair meets in some leaf. A tree over a bounded sample deals
the fingerprints to shards; within a shard the same split goes on down to small
leaves, which are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweave.llm.common import connected_components, first_rows, stored

SHINGLE_WORDS = 3
HASH_SEED = 42
LINK_BITS = 2
SAMPLE_ROWS = 8192
SHARD_ROWS = 2048
LEAF_ROWS = 256
PLAIN_ROWS = 4096
VANTAGE_TRIES = 8
_BLOCK = 1 << 15


def simhash(text: str | None) -> int:
    """Fingerprint of a text as a signed 64-bit number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        block = hashes[start : start + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(T.LongType())
def simhash_of(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def hex_fingerprint(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _choose_split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that leave the smallest larger side; None if no split pays off."""
    best, found = 0.8 * len(points), None
    step = max(1, len(points) // VANTAGE_TRIES)
    for vantage in points[::step][:VANTAGE_TRIES]:
        within = np.bincount(_distances(points, vantage), minlength=65).cumsum()
        beyond = len(points) - np.concatenate([np.zeros(LINK_BITS, int), within])[: len(within)]
        larger = np.maximum(within, beyond)
        radius = int(larger.argmin())
        if larger[radius] < best:
            best, found = larger[radius], (vantage, radius)
    return found


def _sides(points: np.ndarray, vantage: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Who goes inside, and who goes outside; those just inside the radius go both ways."""
    d = _distances(points, vantage).astype(int)
    return d <= radius, d > radius - LINK_BITS


@dataclass(frozen=True)
class ShardTree:
    """Split of the space into shards: ``(vantage, radius, inside, outside)`` or a shard number."""

    root: tuple | int
    shards: int

    @classmethod
    def build(cls, sample: np.ndarray, shards: int) -> ShardTree:
        count = 0

        def grow(points: np.ndarray, share: float) -> tuple | int:
            nonlocal count
            split = _choose_split(points) if share > 1 and len(points) >= 16 else None
            if split is None:
                count += 1
                return count - 1
            inside, outside = _sides(points, *split)
            return (*split, grow(points[inside], share / 2), grow(points[outside], share / 2))

        root = grow(sample, float(shards))
        return cls(root, count)

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard numbers and positions of the points that go there."""
        shards, where = [], []

        def descend(node: tuple | int, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, int):
                shards.append(np.full(len(at), node, np.int32))
                where.append(at)
                return
            vantage, radius, inner, outer = node
            inside, outside = _sides(points[at], vantage, radius)
            descend(inner, at[inside])
            descend(outer, at[outside])

        descend(self.root, np.arange(len(points)))
        if not where:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(shards), np.concatenate(where)


def _spread(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Carry the smallest label along the links (a, b) until nothing changes."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new


def _links_in_full(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = [], []
    for start in range(0, len(points), 512):
        rows = points[start : start + 512]
        i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ points[None, :]) <= LINK_BITS)
        i = i + start
        a.append(i[i < j])
        b.append(j[i < j])
    return np.concatenate(a), np.concatenate(b)


def _links_by_flips(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a dense crowd that no vantage point splits: look up all values near each point."""
    order = np.argsort(points)
    ordered = points[order]
    a, b = [], []
    for n in range(1, LINK_BITS + 1):
        for bits in combinations(range(64), n):
            near = points ^ np.uint64(sum(1 << bit for bit in bits))
            at = np.minimum(np.searchsorted(ordered, near), len(ordered) - 1)
            hit = np.flatnonzero(ordered[at] == near)
            hit = hit[points[hit] < near[hit]]
            a.append(hit)
            b.append(order[at[hit]])
    return np.concatenate(a), np.concatenate(b)


def component_links(points: np.ndarray) -> np.ndarray:
    """Links ``(point, other)`` of distinct points that connect all within ``LINK_BITS`` bits.

    Each leaf gives one link per point to the first of its component there, not
    all pairs.
    """
    found, todo = [], [points]
    while todo:
        part = todo.pop()
        split = _choose_split(part) if len(part) > LEAF_ROWS else None
        if split is not None:
            inside, outside = _sides(part, *split)
            todo += [part[inside], part[outside]]
            continue
        if len(part) < 2:
            continue
        a, b = _links_in_full(part) if len(part) <= PLAIN_ROWS else _links_by_flips(part)
        labels = _spread(np.arange(len(part)), a, b)
        linked = np.flatnonzero(labels != np.arange(len(part)))
        found.append(np.stack([part[linked], part[labels[linked]]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


def _links_of_shard(shard: pd.DataFrame) -> pd.DataFrame:
    links = component_links(np.unique(shard["fp"].to_numpy(np.int64)).view(np.uint64))
    links = links.view(np.int64)
    return pd.DataFrame({"u": links[:, 0], "v": links[:, 1]})


def fingerprint_links(groups: DataFrame, n_groups: int) -> DataFrame:
    """Links ``(u, v)`` that connect all fingerprints within ``LINK_BITS`` bits of each other.

    ``groups`` has one row per distinct fingerprint ``fp``. A sample of at most
    ``SAMPLE_ROWS`` of them shapes the shards; it decides where a pair is found,
    never whether.
    """
    sample = groups.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE_ROWS).collect()
    points = np.array([r["fp"] for r in sample], np.int64).view(np.uint64)
    tree = ShardTree.build(points, max(1, n_groups // SHARD_ROWS))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            shards, where = tree.route(fps.view(np.uint64))
            yield pd.DataFrame({"shard": shards, "fp": fps[where]})

    routed = groups.select("fp").mapInPandas(route, "shard int, fp long")
    return routed.groupBy("shard").applyInPandas(_links_of_shard, "u long, v long")


def _rooted(prints: DataFrame, smallest: dict[str, Column]) -> DataFrame:
    """Per distinct fingerprint ``fp`` of stored rows its component's ``root`` and aggregates of its rows."""
    groups = stored(prints.groupBy("fp").agg(*[c.alias(name) for name, c in smallest.items()]))
    roots = connected_components(fingerprint_links(groups, groups.count()))
    joined = groups.join(roots, groups["fp"] == roots["node"], "left")
    return joined.select("fp", *smallest, F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Documents are in one component if a chain of fingerprints, each within
    ``LINK_BITS`` bits of the next, joins them; ``component_id`` is the smallest
    doc_id in it, null only if all are null. Null, empty and blank texts have
    fingerprint zero, so they are one component. Equal texts share a fingerprint
    and are compared once, however many they are.
    """
    prints = stored(docs.select("doc_id", simhash_of("text").alias("fp")))
    rooted = _rooted(prints, {"first_id": F.min("doc_id")})
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    components = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(components, "fp").select(
        "doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id"
    )


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``.

    It is the one with the smallest doc_id, null ids last, and among rows of one id the
    one whose text has the smallest digest. Unlike texts stay, whether they share a
    doc_id or have none.
    """
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    prints = stored(docs.select("doc_id", digest.alias("digest"), simhash_of("text").alias("fp")))
    rooted = _rooted(prints, {"first": F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "digest"))})
    kept = stored(rooted.groupBy("root").agg(F.min("first").alias("first")))
    left, right = docs.select(F.struct("*").alias("row"), "doc_id", digest.alias("digest")), kept.select(
        F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("digest")
    )
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (left["digest"] == right["digest"])
    # What is left of a component are copies of its row.
    rows = first_rows(left.join(right, same, "left_semi"), ["doc_id", "digest"], [F.col("row.text")])
    return rows.select("row.*")
