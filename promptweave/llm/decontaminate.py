"""Benchmark decontamination: a hash set of benchmark windows, probed at every word of every text.

The windows are a small, counted set that travels with the tasks, so a text is
scanned in its own row: no shuffle, and no document is sent anywhere. A set
beyond ``BLOCK_WINDOWS`` is probed in blocks of that size, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, islice
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweave.llm.common import join_checked, stored

WINDOW_WORDS = 10
BLOCK_WINDOWS = 50_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_WORDS = f"regexp_extract_all(translate(coalesce(CAST(text AS STRING), ''), '{_UPPER}', '{_LOWER}'), r'{_WORD}', 0)"


def normalised_words() -> Column:
    """Runs of digits, letters and non-ASCII characters of ``text``, with A-Z in lower case."""
    return F.expr(_WORDS)


def benchmark_windows(benchmark: DataFrame, words: int = WINDOW_WORDS) -> DataFrame:
    """``(item_id, gram, length, hash)``: windows of each item; an item of fewer words is one."""
    length = f"least(size(_words), {words})"
    starts = f"transform(sequence(1, size(_words) - {length} + 1), i -> slice(_words, i, {length}))"
    windows = (
        benchmark.select("item_id", normalised_words().alias("_words"))
        .where("size(_words) > 0")
        .select("item_id", F.explode(F.expr(starts)).alias("_window"))
    )
    return windows.select(
        "item_id",
        F.array_join("_window", " ").alias("gram"),
        F.size("_window").alias("length"),
        F.expr("xxhash64(transform(_window, w -> xxhash64(w)))").alias("hash"),
    ).distinct()


@dataclass(frozen=True)
class WindowBlock:
    """At most ``BLOCK_WINDOWS`` distinct windows: ``(length, hash, gram)``."""

    windows: Sequence[tuple[int, int, str]]

    def scan_sql(self) -> str:
        """The number of words of ``text`` and its verified hits ``(at, length, gram)``, as a struct.

        Hashes are looked up first; the words of what they find are compared
        in full. Grams hold no ASCII sign but the space, so they need no quoting.
        Words and their hashes are bound to lambda variables: however the
        optimiser moves the expression, they are computed once per row.
        """
        found = []
        for length in sorted({w[0] for w in self.windows}):
            hashes = ", ".join(f"{h}L" for n, h, _ in self.windows if n == length)
            grams = ", ".join(f"'{g}'" for n, _, g in self.windows if n == length)
            last = f"size(hs) - {length - 1}"
            starts = f"IF({last} > 0, sequence(1, {last}), array())"
            probed = f"filter({starts}, i -> xxhash64(slice(hs, i, {length})) IN ({hashes}))"
            named = (
                f"transform({probed}, i -> named_struct('at', i, 'length', {length}, "
                f"'gram', array_join(slice(ws, i, {length}), ' ')))"
            )
            found.append(f"filter({named}, h -> h.gram IN ({grams}))")
        scan = f"named_struct('n_words', size(ws), 'hits', concat({', '.join(found)}))"
        hashed = f"transform(array(transform(ws, w -> xxhash64(w))), hs -> {scan})[0]"
        return f"transform(array({_WORDS}), ws -> {hashed})[0]"


def window_blocks(windows: DataFrame, block: int = BLOCK_WINDOWS) -> Iterator[WindowBlock]:
    """The distinct windows, at most ``block`` of them on the driver at a time."""
    distinct = windows.select("length", "hash", "gram").distinct()
    blocks = -(-distinct.count() // block)
    if blocks > 1:
        # One and a half times as many, as a hash does not deal evenly.
        blocks += -(-blocks // 2)
        distinct = stored(distinct.withColumn("_block", F.pmod(F.xxhash64("gram"), F.lit(blocks))))
    for i in range(blocks):
        rows = distinct if blocks == 1 else distinct.where(F.col("_block") == i)
        found = [(r["length"], r["hash"], r["gram"]) for r in rows.collect()]
        if found:
            yield WindowBlock(sorted(found))


_COVERED = "array_distinct(flatten(transform(_hits, h -> sequence(h.at, h.at + h.length - 1))))"


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs``.

    A null or empty text has no words; a null item text has no windows; a null
    item_id counts as an item but is not listed. Rows that repeat are reported
    as often as they come, rows of an item that repeat count once.
    """
    windows = stored(benchmark_windows(benchmark))
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_key"))
    parts = []
    blocks = window_blocks(windows)
    begin = list(islice(blocks, 2))
    if len(begin) > 1:
        keyed = stored(keyed)  # a scan that is planned anew may give other keys
    for block in chain(begin, blocks):
        scan = keyed.select("_key", "doc_id", F.expr(block.scan_sql()).alias("_scan"))
        parts.append(stored(scan.select("_key", "doc_id", "_scan.n_words", F.col("_scan.hits").alias("_hits"))))
    if not parts:
        none = F.expr("CAST(array() AS array<struct<at:int,length:int,gram:string>>)").alias("_hits")
        parts = [keyed.select("_key", "doc_id", F.size(normalised_words()).alias("n_words"), none)]
    scanned = parts[0]
    for n, part in enumerate(parts[1:]):
        more = part.select("_key", F.col("_hits").alias("_more"))
        scanned = scanned.join(more, "_key").withColumn("_hits", F.concat("_hits", "_more")).drop("_more")
    grams = scanned.where("size(_hits) > 0").select("_key", F.explode(F.expr("array_distinct(_hits.gram)")).alias("gram"))
    items = (
        join_checked(grams, windows.select("gram", "item_id"), ["gram"], "inner")
        .select("_key", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("_key")
        .agg(
            F.count("*").alias("n_items"),
            F.array_join(F.array_sort(F.collect_list("item")), ",").alias("_items"),
        )
    )
    return (
        scanned.select("_key", "doc_id", F.col("n_words").cast("long"), F.expr(f"size({_COVERED})").cast("long").alias("n_hit"))
        .join(items, "_key", "left")
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce("_items", F.lit("")), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window; rows and columns otherwise as they are."""
    kept = docs
    for n, block in enumerate(window_blocks(stored(benchmark_windows(benchmark)))):
        kept = stored(kept) if n else kept
        kept = kept.where(f"size({block.scan_sql()}.hits) = 0")
    return kept


def cut_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, with the words of benchmark windows, and what follows each, cut out of the text."""
    cut = docs
    pieces = "zip_with(_cased, slice(_gaps, 2, size(_cased)), (w, s) -> concat(w, s))"
    left = f"array_except(sequence(1, size(_cased)), {_COVERED})"
    for n, block in enumerate(window_blocks(stored(benchmark_windows(benchmark)))):
        cut = stored(cut) if n else cut
        found = stored(cut.withColumn("_hits", F.expr(f"{block.scan_sql()}.hits")))
        found = found.withColumns(
            {"_cased": F.regexp_extract_all("text", F.lit(_CASED_WORD), F.lit(0)), "_gaps": F.split("text", _CASED_WORD, -1)}
        ).withColumns({"_pieces": F.expr(pieces), "_left": F.expr(left)})
        rebuilt = F.expr("concat(_gaps[0], array_join(transform(_left, i -> _pieces[i - 1]), ''))")
        found = found.withColumn("text", F.when(F.size("_hits") > 0, rebuilt).otherwise(F.col("text")))
        cut = found.select(*docs.columns)
    return cut
