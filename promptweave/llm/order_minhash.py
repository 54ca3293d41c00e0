"""Order MinHash fingerprints, sensitive to edit distance, with built-in functions only.

A text is cut into tokens (runs of up to eight signs that are not blank) and
these into overlapping k-mers of five. Equal k-mers of a text are numbered, so
repetition counts. One hash per numbered k-mer deals them to bins (one
permutation hashing); each bin picks its two smallest and hashes them in the
order in which they stand in the text.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptweave.llm.common import text_or_empty

KMER_TOKENS = 5
BINS = 64
TOKEN = r"\S{1,8}"
# A number holds the hash of a k-mer in its high bits and the place in the text in the low ones.
PLACE = (1 << 31) - 1
BIN_SHIFT = 64 - int(math.log2(BINS))
BUCKETS_PER_PARTITION = 4
TIES = 1 << 32


def with_signature(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add the signature of a text: per bin that is not empty, its number and a hash of its picks.

    A text of fewer than five tokens is one k-mer; one without tokens has an
    empty signature. Steps are columns of their own that later steps use more
    than once, so that each is computed once and the sorts run on plain numbers.
    """
    others = [c for c in df.columns if c != out]
    high = f"{~PLACE}L"
    hashed = df.select(
        *others,
        F.expr(f"transform(regexp_extract_all({text_col}, r'{TOKEN}', 0), t -> xxhash64(t))").alias("_hashes"),
    )
    last = f"greatest(size(_hashes) - {KMER_TOKENS - 1}, 1)"
    kmers = (
        f"IF(size(_hashes) = 0, CAST(array() AS array<bigint>), sort_array(transform(sequence(1, {last}), "
        f"i -> (xxhash64(slice(_hashes, i, {KMER_TOKENS})) & {high}) | i)))"
    )
    keyed = hashed.select(*others, F.expr(kmers).alias("_kmers"))
    starts = (
        f"filter(sequence(0, size(_kmers) - 1), i -> i = 0 OR (_kmers[i] & {high}) <> (_kmers[i - 1] & {high}))"
    )
    grouped = keyed.select(
        *others,
        "_kmers",
        F.expr(f"IF(size(_kmers) = 0, CAST(array() AS array<int>), {starts})").alias("_starts"),
    )
    number = f"(k, o) -> (xxhash64(k & {high}, o) & {high}) | (k & {PLACE}L)"
    repeated = (
        "flatten(zip_with(_starts, concat(slice(_starts, 2, size(_starts)), array(size(_kmers))), "
        "(a, b) -> sequence(1, b - a)))"
    )
    numbered = grouped.select(
        *others,
        F.expr(
            f"sort_array(IF(size(_starts) = size(_kmers), "
            f"transform(_kmers, k -> (xxhash64(k & {high}, 1) & {high}) | (k & {PLACE}L)), "
            f"zip_with(_kmers, {repeated}, {number})))"
        ).alias("_numbered"),
    )
    bin_of = lambda x: f"shiftrightunsigned({x}, {BIN_SHIFT})"
    first = f"i = 0 OR {bin_of('_numbered[i]')} <> {bin_of('_numbered[i - 1]')}"
    heads = numbered.select(
        *others,
        "_numbered",
        F.expr(
            f"IF(size(_numbered) = 0, CAST(array() AS array<int>), "
            f"filter(sequence(0, size(_numbered) - 1), i -> {first}))"
        ).alias("_heads"),
    )
    # The pick of a bin of one k-mer is that k-mer twice.
    second = (
        f"IF(i + 1 < size(_numbered) AND {bin_of('_numbered[i + 1]')} = {bin_of('_numbered[i]')}, "
        "_numbered[i + 1], _numbered[i])"
    )
    return heads.select(*others, F.expr(_pick_sql(high, bin_of, second)).alias(out))


def _pick_sql(high: str, bin_of, second: str) -> str:
    ordered = (
        f"IF((p.a & {PLACE}L) <= (p.b & {PLACE}L), xxhash64(p.a & {high}, p.b & {high}), "
        f"xxhash64(p.b & {high}, p.a & {high}))"
    )
    pairs = f"transform(_heads, i -> named_struct('a', _numbered[i], 'b', {second}))"
    return f"transform({pairs}, p -> CAST({bin_of('p.a')} * 65536 + ({ordered} & 65535L) AS INT))"


def likeness(a: str, b: str) -> Column:
    """Share of equal picks among the bins that either signature fills; 1 for two empty ones."""
    bins = f"size(array_union(transform({a}, x -> x div 65536), transform({b}, x -> x div 65536)))"
    same = f"size(array_intersect({a}, {b}))"
    return F.expr(f"IF({bins} = 0, 1.0D, CAST({same} AS DOUBLE) / {bins})")


def as_text(signature: str) -> Column:
    """A signature as text: six hexadecimal digits per bin that is not empty."""
    return F.expr(f"lower(array_join(transform(array_sort({signature}), x -> lpad(hex(x), 6, '0')), ''))")


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """Deal rows to ranges of ``(doc_id, _tie)`` of about equal depth; null ids are the smallest.

    A row's place is its doc_id plus a fraction from its tie, so rows that share
    a doc_id are split as well. Rounding may put neighbours in one range, never
    out of order.
    """
    smallest = docs.agg(F.min("doc_id")).first()[0] or 0
    fraction = F.col("_tie") / F.lit(float(TIES))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float(smallest) - 1.0)) + fraction
    placed = docs.withColumn("_place", place)
    steps = [i / buckets for i in range(1, buckets)]
    borders = sorted(set(placed.approxQuantile("_place", steps, 0.25 / buckets))) if steps else []
    if not borders:
        return docs.withColumn("_bucket", F.lit(0))
    splits = [-math.inf, *borders, math.inf]
    dealt = Bucketizer(splits=splits, inputCol="_place", outputCol="_bucket").transform(placed)
    return dealt.withColumn("_bucket", F.col("_bucket").cast("int")).drop("_place")


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``_next``: a struct of ``columns`` of the next row by descending doc_id; the last's is the first.

    Rows are sorted within ranges of doc_ids, not in one task. The last row of
    each range is sent to the range above as well, so only one row per range is
    copied. Rows that share a doc_id are ordered by a hash of their text, null
    ids are the smallest.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = docs.withColumn("_tie", F.pmod(F.xxhash64("text"), F.lit(TIES)))
    placed = _bucketed(tied, buckets or BUCKETS_PER_PARTITION * partitions)
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_tie")).alias("last")
    ends = sorted(placed.groupBy("_bucket").agg(last).collect())
    above = [e["_bucket"] for e in ends[1:] + ends[:1]]
    guests = docs.sparkSession.createDataFrame(
        [(e["last"]["doc_id"], e["last"]["_tie"], to) for e, to in zip(ends, above, strict=True)],
        "_end_id long, _end_tie long, _above int",
    )
    at_end = F.col("doc_id").eqNullSafe(F.col("_end_id")) & (F.col("_tie") == F.col("_end_tie"))
    homes = F.array(
        F.struct(F.col("_bucket").alias("bucket"), F.lit(True).alias("own")),
        F.struct(F.col("_above").alias("bucket"), F.lit(False).alias("own")),
    )
    spread = (
        placed.join(F.broadcast(guests), at_end, "left")
        .withColumn("_home", F.explode(homes))
        .where("_home.bucket IS NOT NULL")
    )
    order = Window.partitionBy("_home.bucket").orderBy("_home.own", F.col("doc_id").asc_nulls_first(), "_tie")
    following = spread.withColumn("_next", F.lag(F.struct(*columns)).over(order)).where("_home.own")
    return following.select(*docs.columns, "_next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and how alike they are.

    The edited text has the last half of the text (rounded down) replaced by as
    many code points from the start of the next document's, or all it has. A
    null text is empty; an empty table gives an empty one; rows that repeat
    follow each other.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    signed = with_signature(texts, "text", "sig")
    paired = with_next(signed, ["text", "sig"])
    cut = "CAST(floor(length(text) / 2) AS INT)"
    edited = paired.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "sig",
        F.col("_next.sig").alias("next_sig"),
        F.expr(f"concat(left(text, length(text) - {cut}), left(_next.text, {cut}))").alias("edited"),
    )
    both = with_signature(edited, "edited", "edited_sig")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sig").alias("fingerprint"),
        as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )
