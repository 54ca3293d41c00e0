"""Removal of repeated byte strings by hash-compared suffix sorting.

Every 400-byte window is owned by an anchor, the 64-byte string in it with the
smallest hash, so equal windows have equal anchors at equal places. Anchors that
occur once settle their windows. The others are dealt to shards by hash, and the
suffixes (and reversed prefixes) at the anchors of equal hash are sorted by
merging: prefix hashes and binary search give the common extension of two
suffixes in a logarithmic number of steps. Two anchors share a window that
starts o bytes before them if they agree on o bytes to the left and 400 - o to
the right, that is, if they are in one run of both orders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweave.llm.common import join_checked, stored, text_or_empty

WINDOW = 400
GRAM = 64
SHARD_FRAGMENTS = 4096
CROWD_FRAGMENTS = 20_000
CLASS = 43
_CHUNK = 1 << 20
_PLACE = np.uint64((1 << 31) - 1)
# An odd multiplier, and a number per byte value drawn from a fixed seed.
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64)
ANCHORS = "h long, fh long, n long, key binary, at long, lo long, hi long"


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base % (1 << 64), np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_INVERSE = pow(_BASE, -1, 1 << 64)
_UP = _powers(_BASE, _CHUNK + WINDOW)
_DOWN = _powers(_INVERSE, _CHUNK + WINDOW)


def _sums(data: np.ndarray, places: np.ndarray | slice) -> np.ndarray:
    """Running sums of byte numbers times powers: differences are polynomial hashes modulo 2**64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[places], out=sums[1:])
    return sums


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row, from running minima within blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _anchors_of_chunk(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, place, first and last window start of each anchor; the leftmost of equal ones counts."""
    sums = _sums(data, slice(0, len(data)))
    hashes = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(data) - GRAM + 1]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    owner = (_lowest(ranked, WINDOW - GRAM + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], len(owner)) - 1
    return hashes[owner[first]].view(np.int64), owner[first], first, last


def anchors(data: bytes) -> tuple[list[tuple], list[tuple[int, int]]]:
    """``(h, fh, n, at, lo, hi)`` of a text's anchors, and window starts known to repeat within it.

    ``lo`` and ``hi`` are the first and last start of the windows an anchor
    owns, ``fh`` is a hash of their bytes. Of equal fragments one is returned.
    """
    found: dict[tuple[int, int], list] = {}
    repeated = []
    for begin in range(0, len(data) - WINDOW + 1, _CHUNK - WINDOW):
        part = np.frombuffer(data, np.uint8)[begin : begin + _CHUNK - 1]
        for h, at, lo, hi in zip(*(x.tolist() for x in _anchors_of_chunk(part)), strict=True):
            piece = data[begin + lo : begin + hi + WINDOW]
            fh = xxhash.xxh64_intdigest(piece, at - lo)
            fh -= (fh >> 63) << 64
            known = found.get((h, fh))
            if known is None:
                found[h, fh] = [1, begin + at, begin + lo, begin + hi]
            else:
                known[0] += 1
                repeated.append((begin + lo, begin + hi))
    repeated += [(lo, hi) for n, _, lo, hi in found.values() if n > 1]
    return [(h, fh, *rest) for (h, fh), rest in found.items()], merged(repeated)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of integers, ends included, with those that touch joined."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each text; a range that repeats within one text has no hash."""
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ANCHORS.split(", ")])
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(0):
            data = text.as_buffer().to_pybytes()
            if len(data) < WINDOW:
                continue
            key = hashlib.md5(data).digest()
            found, repeated = anchors(data)
            rows += [(h, fh, n, key, at, lo, hi) for h, fh, n, at, lo, hi in found]
            rows += [(None, None, 2, key, lo, lo, hi) for lo, hi in repeated]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema
            )


def _common(sums: np.ndarray, local: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, by binary search on prefix hashes."""
    low, high = np.zeros_like(most), most.copy()
    scale_a, scale_b = _DOWN[local[a]], _DOWN[local[b]]
    start_a, start_b = sums[a], sums[b]
    while (low < high).any():
        middle = (low + high + 1) // 2
        equal = (sums[a + middle] - start_a) * scale_a == (sums[b + middle] - start_b) * scale_b
        low = np.where(equal, middle, low)
        high = np.where(equal, high, middle - 1)
    return low


def sorted_suffixes(
    data: np.ndarray, local: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes within their groups (contiguous), and what each shares with the one before.

    Merges runs of 1, 2, 4, ... in all groups at once; an element's place is its
    own plus its rank in the run beside it. ``local`` is the place of each byte
    within its fragment. Shared lengths are verified byte by byte; where a hash
    was wrong the group is sorted by plain comparison instead.
    """
    n = len(start)
    sums = _sums(data, local)
    padded = np.append(data, 0).astype(np.int16)
    local = np.append(local, 0)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(first, n))
    begin, end = np.repeat(first, size), np.repeat(first + size, size)
    order = np.arange(n)
    slot = np.arange(n)
    width = 1

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y, or is equal where ``ties`` says so."""
        a, b = start[x], start[y]
        most = np.minimum(length[x], length[y])
        same = _common(sums, local, a, b, most)
        inside = same < most
        byte = padded[np.where(inside, a + same, len(data))] < padded[np.where(inside, b + same, len(data))]
        shorter = (length[x] < length[y]) | (ties & (length[x] == length[y]))
        return np.where(inside, byte, shorter)

    while width < size.max(initial=0):
        run = (slot - begin) // width
        other = begin + (run ^ 1) * width
        low, high = np.minimum(other, end), np.minimum(other + width, end)
        second = run % 2 == 1
        at, top = low.copy(), high.copy()
        active = np.flatnonzero(at < top)
        while len(active):
            middle = (at[active] + top[active]) // 2
            goes = before(order[middle], order[active], second[active])
            at[active] = np.where(goes, middle + 1, at[active])
            top[active] = np.where(goes, top[active], middle)
            active = active[at[active] < top[active]]
        place = begin + (run // 2) * 2 * width + (slot - begin - run * width) + (at - low)
        merged_order = np.empty_like(order)
        merged_order[place] = order
        order = merged_order
        width *= 2
    shared = np.full(n, -1, np.int64)
    pairs = np.flatnonzero(np.diff(group, prepend=-1) == 0)
    a, b = order[pairs - 1], order[pairs]
    most = np.minimum(length[a], length[b])
    shared[pairs] = _common(sums, local, start[a], start[b], most)
    if not _verified(data, start[a], start[b], most, shared[pairs]):
        return _plain_sort(data, start, length, first, size)
    return order, shared


def _verified(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, shared: np.ndarray) -> bool:
    """Whether all pairs agree on the bytes they are said to share, and on no more."""
    ends = shared < most
    if (data[a[ends] + shared[ends]] == data[b[ends] + shared[ends]]).any():
        return False
    for begin in range(0, len(a), 2048):
        part = slice(begin, begin + 2048)
        spots = np.repeat(np.arange(len(shared[part])), shared[part])
        steps = np.arange(len(spots)) - np.repeat(shared[part].cumsum() - shared[part], shared[part])
        if (data[a[part][spots] + steps] != data[b[part][spots] + steps]).any():
            return False
    return True


def _plain_sort(data, start, length, first, size) -> tuple[np.ndarray, np.ndarray]:
    suffix = [data[s : s + n].tobytes() for s, n in zip(start, length, strict=True)]
    order, shared = [], []
    for f, n in zip(first, size, strict=True):
        own = sorted(range(f, f + n), key=suffix.__getitem__)
        order += own
        shared.append(-1)
        for x, y in zip(own, own[1:], strict=False):
            most = min(len(suffix[x]), len(suffix[y]))
            same = np.frombuffer(suffix[x][:most], np.uint8) == np.frombuffer(suffix[y][:most], np.uint8)
            shared.append(int(same.argmin()) if not same.all() else most)
    return np.array(order, np.int64), np.array(shared, np.int64)


def repeated_windows(groups: np.ndarray, pieces: list[bytes], offsets: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """For each fragment the starts, relative to its anchor, of windows that occur elsewhere.

    Fragments of one group (of equal anchor hash) are contiguous. Ranges are
    flat lists ``lo, hi, lo, hi, ...`` with ends included.
    """
    n = len(pieces)
    length = np.fromiter(map(len, pieces), np.int64, n)
    base = np.append(0, length.cumsum())[:-1]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    local = np.arange(len(data)) - np.repeat(base, length)
    forward, right = sorted_suffixes(data, local, base + offsets, length - offsets, groups)
    back = data[::-1]
    back_local = (np.repeat(length, length) - 1 - local)[::-1]
    backward, left = sorted_suffixes(back, back_local, len(data) - (base + offsets), offsets, groups)
    repeats = np.zeros((WINDOW - GRAM + 1, n), bool)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(min(offsets.max(initial=0), WINDOW - GRAM)) + 1):
        ahead[forward] = (right < WINDOW - o).cumsum()
        behind[backward] = (left < o).cumsum()
        code = ahead * (n + 1) + behind
        order = np.argsort(code, kind="stable")
        equal = np.diff(code[order]) == 0
        repeats[o, order[1:][equal]] = True
        repeats[o, order[:-1][equal]] = True
        # A window must lie within the fragment; copies of a fragment settle its own.
        within = (offsets >= o) & (length - offsets >= WINDOW - o)
        repeats[o] = within & (repeats[o] | (counts > 1))
    out = []
    padded = np.zeros((repeats.shape[0] + 2, n), np.int8)
    padded[1:-1] = repeats[::-1]
    for column in range(n):
        turns = np.diff(padded[:, column])
        lows, highs = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) - 1
        out.append([int(x) - (WINDOW - GRAM) for pair in zip(lows, highs, strict=True) for x in pair])
    return out


def _solve_shard(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values(["crowd", "part"], ignore_index=True)
    groups = (shard["crowd"].diff() != 0).cumsum().to_numpy(np.int64)
    ranges = repeated_windows(
        groups, [bytes(p) for p in shard["piece"]], shard["off"].to_numpy(np.int64), shard["n"].to_numpy(np.int64)
    )
    return pd.DataFrame({"crowd": shard["crowd"], "part": shard["part"], "ranges": ranges})


def _solved(pieces: DataFrame, n_pieces: int) -> DataFrame:
    """``(crowd, part, ranges)`` of pieces ``(crowd, part, n, off, piece)``; crowds are dealt to shards whole."""
    shards = max(1, n_pieces // SHARD_FRAGMENTS)
    return (
        pieces.withColumn("shard", F.pmod(F.xxhash64("crowd"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_solve_shard, "crowd long, part long, ranges array<long>")
        .where("size(ranges) > 0")
    )


def _split_crowds(pieces: DataFrame) -> DataFrame:
    """Cut the pieces of crowded anchors by where a window starts before the anchor.

    The windows of one class of ``CLASS`` neighbouring starts share a core of
    their bytes, and two pieces can share one only if their cores are equal. So
    each class is a crowd per core, and of the piece only what its windows
    cover: pieces that differ elsewhere become equal and count once.
    """
    core = WINDOW - CLASS + 1
    classes = -(-(WINDOW - GRAM + 1) // CLASS)
    return (
        pieces.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit((classes - 1) * CLASS), F.lit(CLASS))))
        .where(f"off >= c AND off - c + {core} <= octet_length(piece)")
        .withColumn("begin", F.expr(f"greatest(0, off - c - {CLASS - 1})"))
        .select(
            "h",
            "fh",
            "n",
            F.expr(f"xxhash64(h, c, substring(piece, CAST(off - c + 1 AS INT), {core}))").alias("crowd"),
            F.expr("off - begin").alias("off"),
            F.expr(f"substring(piece, CAST(begin + 1 AS INT), CAST(off - c + {WINDOW} - begin AS INT))").alias("piece"),
        )
        .withColumn("part", F.xxhash64("piece", "off"))
    )


def _by_single_window(pieces: DataFrame) -> DataFrame:
    """``(crowd, part, ranges)`` of pieces ``(crowd, part, n, off, piece)``, by a digest of each window.

    For crowds that stay crowded: equal digests are summed before the shuffle
    and joined back, so no task gathers a crowd.
    """
    windows = pieces.withColumn("p", F.explode(F.expr(f"sequence(0, CAST(octet_length(piece) AS INT) - {WINDOW})"))).select(
        "crowd",
        "part",
        "n",
        (F.col("p") - F.col("off")).alias("start"),
        F.unhex(F.sha2(F.expr(f"substring(piece, p + 1, {WINDOW})"), 256)).alias("window"),
    )
    repeated = stored(windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window"))
    found = (
        join_checked(windows, repeated, ["window"], "left_semi")
        .groupBy("crowd", "part")
        .agg(F.array_sort(F.collect_set("start")).alias("s"))
    )
    ends = "filter(s, x -> NOT array_contains(s, x - 1)), filter(s, x -> NOT array_contains(s, x + 1))"
    return found.select("crowd", "part", F.expr(f"flatten(zip_with({ends}, (a, b) -> array(a, b)))").alias("ranges"))


def _ranges_of_fragments(docs: DataFrame, fragments: DataFrame) -> DataFrame:
    """``(h, fh, ranges)`` of the fragments that hold windows which occur elsewhere."""
    crowded = stored(
        fragments.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > CROWD_FRAGMENTS).select("h")
    )
    n_crowded = crowded.count()

    def pieces(chosen: DataFrame) -> DataFrame:
        return _texts_of(docs, chosen.select("key").distinct()).join(chosen, "key").select(
            "h",
            "fh",
            "n",
            (F.col("at") - F.col("lo")).alias("off"),
            F.expr(f"substring(CAST(text AS BINARY), CAST(lo + 1 AS INT), CAST(hi - lo + {WINDOW} AS INT))").alias("piece"),
        )

    few = join_checked(fragments, crowded, ["h"], "left_anti", rows=n_crowded) if n_crowded else fragments
    named = pieces(few).withColumnsRenamed({"h": "crowd", "fh": "part"})
    solved = _solved(named, fragments.count())
    found = solved.select(F.col("crowd").alias("h"), F.col("part").alias("fh"), "ranges")
    if n_crowded:
        many = join_checked(fragments, crowded, ["h"], "left_semi", rows=n_crowded)
        parts = stored(_split_crowds(pieces(many)))
        once = stored(
            parts.groupBy("crowd", "part").agg(
                F.sum("n").alias("n"), F.first("off").alias("off"), F.first("piece").alias("piece")
            )
        )
        # Pieces that differ beside a common core are one crowd still.
        still = stored(
            once.groupBy("crowd").agg(F.count("*").alias("c")).where(F.col("c") > CROWD_FRAGMENTS).select("crowd")
        )
        n_still = still.count()
        rest = join_checked(once, still, ["crowd"], "left_anti", rows=n_still) if n_still else once
        split = _solved(rest, once.count())
        if n_still:
            split = split.union(_by_single_window(join_checked(once, still, ["crowd"], "left_semi", rows=n_still)))
        found = found.union(parts.join(split, ["crowd", "part"]).select("h", "fh", "ranges"))
    return found


def text_key(text_col: str = "text") -> Column:
    """Identity of a text: a 128-bit digest, so equal texts are looked at once."""
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row ``(key, text)`` for each of the keys."""
    keyed = docs.select(text_or_empty().alias("text")).select(text_key().alias("key"), "text")
    return join_checked(keyed, stored(keys), ["key"], "left_semi").dropDuplicates(["key"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``(key, lo, hi)``: starts of windows of each distinct text that occur elsewhere as well."""
    texts = docs.select(text_or_empty().alias("text")).where(F.octet_length("text") >= WINDOW)
    found = texts.mapInArrow(_emit, ANCHORS)
    shared = stored(
        found.where("h IS NOT NULL")
        .groupBy("h")
        .agg(F.sum("n").alias("n"), (F.min("fh") != F.max("fh")).alias("mixed"))
        .where("n > 1")
        .drop("n")
    )
    # A copy of a text repeats its anchors; counting them keeps one row for each.
    candidates = stored(
        join_checked(found.where("h IS NOT NULL"), shared, ["h"], "inner")
        .groupBy("h", "fh", "mixed", "key", "at", "lo", "hi")
        .agg(F.sum("n").alias("n"))
    )
    within = found.where("h IS NULL").select("key", "lo", "hi").distinct()
    whole = candidates.where("NOT mixed").select("key", "lo", "hi")
    fragments = stored(
        candidates.where("mixed")
        .groupBy("h", "fh")
        .agg(F.sum("n").alias("n"), F.min(F.struct("key", "at", "lo", "hi")).alias("rep"))
        .select("h", "fh", "n", "rep.*")
    )
    solved = _ranges_of_fragments(docs, fragments)
    mixed = (
        join_checked(candidates.where("mixed"), stored(solved), ["h", "fh"], "inner")
        .select("key", "at", F.expr("explode(sequence(0, size(ranges) - 2, 2))").alias("i"), "ranges")
        .select("key", F.expr("at + ranges[i]").alias("lo"), F.expr("at + ranges[i + 1]").alias("hi"))
    )
    return within.union(whole).union(mixed)


_SPANS = T.StructType(
    [
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def cut(data: bytes, starts: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Removed spans (end exclusive) of a text whose windows at ``starts`` go, and what is left."""
    spans = [(lo, hi + 1) for lo, hi in merged([(lo, hi + WINDOW - 1) for lo, hi in starts])]
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(data[at:lo])
        at = hi
    return spans, b"".join([*kept, data[at:]])


@F.pandas_udf(_SPANS)
def _removal(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
    rows = []
    for text, ranges in zip(texts, starts, strict=True):
        spans, kept = cut(text.encode(), [(r["lo"], r["hi"]) for r in ranges])
        rows.append((sum(hi - lo for lo, hi in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=_SPANS.names)


@F.pandas_udf(T.StringType())
def _left(texts: pd.Series, starts: pd.Series) -> pd.Series:
    left = (cut(t.encode(), [(r["lo"], r["hi"]) for r in rs])[1] for t, rs in zip(texts, starts, strict=True))
    return pd.Series([kept.decode("utf-8", "ignore") for kept in left])


def _ranges_per_text(docs: DataFrame) -> DataFrame:
    ranges = repeated_ranges(docs).distinct()
    return stored(ranges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("starts")))


def repeats_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``docs``.

    A null text is empty; texts of fewer than 400 bytes lose nothing; of equal
    texts with at least 400 bytes, whatever their ids, nothing is left.
    """
    starts = _ranges_per_text(docs)
    removed = (
        _texts_of(docs, starts.select("key")).join(starts, "key").select("key", _removal("text", "starts").alias("r"))
    )
    narrow = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id",
        text_key().alias("key"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("_whole"),
    )
    return narrow.join(removed, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("r.n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("r.n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("r.kept_sha256", "_whole").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of the texts; a sign that is cut in two goes."""
    starts = _ranges_per_text(docs)
    keyed = docs.withColumn("_key", text_key())
    joined = keyed.join(starts.withColumnRenamed("key", "_key"), "_key", "left")
    text = F.when(F.col("starts").isNull(), F.col("text")).otherwise(
        _left(text_or_empty(), F.coalesce("starts", F.expr("CAST(array() AS array<struct<lo:bigint,hi:bigint>>)")))
    )
    return joined.withColumn("text", text).select(*docs.columns)
