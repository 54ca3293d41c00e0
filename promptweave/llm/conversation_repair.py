"""Structure repair of conversations over a graph of shared signature suffixes.

A conversation's signature has one sign per row: the role's initial and the row's
fault. What repair costs from some row on depends on the rest of the signature and
on the grammar state alone, so equal suffixes are one node: signatures are sorted
from their ends, and a walk over that order keeps the nodes of the current suffix.
Each node is made once per task and holds, for every grammar state, the cost to go
and the first edit of the best audit suffix; the edit leads to the next node, where
the suffix goes on. Nodes whose costs differ by a constant share their step.

Only narrow rows (ids, initials, digests) are sorted for the signatures. A signature
has one byte per row, as many as the audit that is asked for, and a signature of very
many conversations is split over tasks by their ids. Texts are shuffled once, to be
written in order after their audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweave.session import scratch_path

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
# Grammar (s?(ua)+)?: nothing read yet, or the initial read last.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The one role that may be put in at a state, and the state it leads to.
PUT_IN = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
LEGAL_PAIRS = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"
GONE = "x"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")

_NEVER = 1 << 40
_ROWS = 512


def _text(column: str, missing: str = " ") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(missing))


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` after a hash of id and turn has damaged the rows.

    Of every twenty values one drops the row (``copies`` 0), one empties its text, one
    takes ``.!?`` away, one repeats it, one makes it the user's. A null counts as a blank.
    """
    draw = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(_text("text"), ".!?", "")).otherwise(_text("text"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(draw == 4, "user").otherwise(_text("role")).alias("role"),
        text.alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """The rows with the digest of their text, and its own fault: blank, truncated or none."""
    seen = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(seen == "", "b").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    return rows.withColumns({"key": F.md5(F.col("text").cast("binary")), "fault": fault})


def _narrow(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with their number, and whether an earlier turn has the same row."""
    same = F.md5(F.concat_ws("\0", F.to_json(F.struct("conv_id")), "role", "key").cast("binary"))
    columns = ["conv_id", "turn", "role", "key", "fault"]
    marked = _marked(rows).select(*columns, "copies").groupBy(*columns).agg(F.sum("copies").alias("copies"))
    marked = marked.withColumns({"same": same, "when": F.struct(F.isnotnull("turn"), "turn")})
    # Few rows repeat, and minima are combined before the shuffle: no task gathers what is said most.
    lasting = marked.where("copies > 0").groupBy("same")
    first = lasting.agg(F.count("*").alias("turns"), F.min("when").alias("first")).where("turns > 1")
    later = F.coalesce(F.col("when") > F.col("first"), F.lit(False))
    return marked.join(first, "same", "left").select(*columns, "copies", later.alias("later"))


class _Batch:
    """Rows to be returned, as Arrow batches of one schema."""

    def __init__(self, kinds: list[tuple[str, pa.DataType]], size: int = 2048):
        self.schema, self.size, self.rows = pa.schema(kinds), size, []

    def full(self) -> bool:
        return len(self.rows) >= self.size

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(self.schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


class _Signature:
    """Signs and counts of one conversation while its rows go by in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.signs = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.initial = None
        self.turns = 0

    def add(self, turn: int | None, role: str, fault: str, copies: int, later: bool) -> None:
        if not copies:
            return
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL_PAIRS
        self.illegal += copies - 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if fault == "b":
            self.blank += copies
            self.signs += GONE.encode() * copies
            return
        repeats = copies if later else copies - 1
        self.duplicate += repeats
        if not later:
            self.truncated += fault == "t"
            sign = initial if initial in ("s", "u", "a") else "o"
            self.signs += (sign.upper() if fault == "t" else sign).encode()
        self.signs += GONE.encode() * repeats

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        self.signs.reverse()
        return self.conv_id, self.signs.decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation to one row each: the signature from its end, and the counts."""
    out, now = None, None
    for batch in batches:
        if out is None:
            kinds = [("conv_id", batch.schema.field(0).type), ("ending", pa.string())]
            out = _Batch(kinds + [(c, pa.int64()) for c in COUNTS])
        for conv_id, *row in _records([batch]):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out.rows.append(now.row())
                    if out.full():
                        yield out.take()
                now = _Signature(conv_id)
            now.add(*row)
    if now is not None:
        out.rows.append(now.row())
        yield out.take()


@lru_cache(maxsize=1 << 14)
def _node(rest: tuple[int, ...] | None, sign: str) -> tuple[int, tuple[int, ...], str]:
    """A node made of a sign and the costs to go after it: least cost, costs above it, first edits.

    ``rest`` is None at the end of all signatures. Of edits that cost the same the
    one first in ASCII wins; as each edit has a letter of its own, what follows it
    needs no look.
    """
    choices: list[dict[str, int]] = []
    for state in range(4):
        if rest is None:
            choices.append({"": 0} if state in (START, ASSISTANT) else {})
            continue
        found = {DELETE: COST[DELETE] + rest[state]}
        if sign != GONE:
            more = TRUNCATED_COST * sign.isupper()
            found[REROLE] = COST[REROLE] + more + rest[PUT_IN[state][0]]
            if (after := KEEPS[state].get(sign.lower())) is not None:
                found[KEEP] = COST[KEEP] + more + rest[after]
        choices.append(found)
    costs = [min(c.values(), default=_NEVER) for c in choices]
    for _ in range(3):  # one insertion may need another after it
        costs = [min(cost, COST[INSERT] + costs[PUT_IN[state][0]]) for state, cost in enumerate(costs)]
    for state, found in enumerate(choices):
        found[INSERT] = COST[INSERT] + costs[PUT_IN[state][0]]
    edits = [min(c, key=lambda e, c=c: (c[e], e)) for c in choices]
    least = min(costs)
    # The end has no edit in two states; a blank keeps one sign for each.
    return least, tuple(c - least for c in costs), "".join(e or " " for e in edits)


class SuffixGraph:
    """The nodes of one signature, from its end on; what the next one shares of them stays."""

    def __init__(self):
        self.ending = ""
        self.least, self.costs, self.edits = ([x] for x in _node(None, ""))

    def follow(self, ending: str) -> None:
        """Go to the node of a signature that is given from its end."""
        shared = len(commonprefix([self.ending, ending]))
        for steps in (self.least, self.costs, self.edits):
            del steps[shared + 1 :]
        for sign in ending[shared:]:
            least, costs, edits = _node(self.costs[-1], sign)
            self.least.append(self.least[-1] + least)
            self.costs.append(costs)
            self.edits.append(edits)
        self.ending = ending

    def best(self) -> tuple[int, str]:
        """Cost and audit of the whole signature."""
        cost, state, at, audit = self.least[-1] + self.costs[-1][START], START, len(self.ending), []
        while (edit := self.edits[at][state]) != " ":
            audit.append(edit)
            if edit == KEEP:
                state = KEEPS[state][self.ending[at - 1].lower()]
            elif edit != DELETE:
                state = PUT_IN[state][0]
            at -= edit != INSERT
        return cost, "".join(audit)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures sorted from their ends to cost and audit; equal ones are looked at once."""
    graph, best, out = SuffixGraph(), None, None
    for batch in batches:
        if out is None:
            kinds = [("conv_id", batch.schema.field(0).type), ("audit", pa.string()), ("cost", pa.int64())]
            out = _Batch(kinds + [(c, pa.int64()) for c in COUNTS])
        for conv_id, ending, *counts in _records([batch]):
            if best is None or ending != graph.ending:
                graph.follow(ending)
                best = graph.best()
            out.rows.append((conv_id, best[1], best[0], *counts))
            if out.full():
                yield out.take()
    if out is not None:
        yield out.take()


def _struct(rows: DataFrame, fields: str) -> T.StructType:
    own = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    return T.StructType([own, *T.StructType.fromDDL(fields).fields])


_COUNTED = ", ".join(f"{c} long" for c in COUNTS)


def audits(rows: DataFrame) -> DataFrame:
    """``(conv_id, audit, cost, gaps, blank, duplicate, truncated, illegal)`` of rows with ``copies``.

    Rows of a turn come in the order of role and text digest; null turns come first. A
    conversation none of whose rows is left has zeros and an empty audit.
    """
    spark = rows.sparkSession
    ordered = _narrow(rows).select("conv_id", "turn", "role", "fault", "copies", "later", "key")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "key").drop("key")
    signed = ordered.mapInArrow(_signatures, _struct(rows, f"ending string, {_COUNTED}"))
    path = scratch_path(spark, "signatures")
    signed.write.parquet(path)
    dealt = spark.read.parquet(path).repartitionByRange("ending", F.xxhash64("conv_id"))
    found = dealt.sortWithinPartitions("ending").mapInArrow(_audits, _struct(rows, f"audit string, cost long, {_COUNTED}"))
    path = scratch_path(spark, "audits")
    found.write.parquet(path)
    return spark.read.parquet(path)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit row, then its rows in order, to that audit row and the repaired rows."""
    out, conv, audit, at, state, place = None, None, "", 0, START, 0
    counts: list = [None] * (len(COUNTS) + 1)

    def insertions(audit: str, at: int, state: int) -> Iterator[tuple[int, int, str]]:
        while at < len(audit) and audit[at] == INSERT:
            state, role = PUT_IN[state]
            at += 1
            yield at, state, role

    for batch in batches:
        if out is None:
            kinds = [("conv_id", batch.schema.field(0).type), ("position", pa.int64()), ("edit", pa.string())]
            kinds += [("role", pa.string()), ("text", pa.string()), ("audit", pa.string())]
            out = _Batch(kinds + [(c, pa.int64()) for c in ("cost", *COUNTS)], _ROWS)
        for conv_id, head, role, text, copies, new_audit, *head_counts in _records([batch]):
            for _ in range(1 if head else copies):
                if head:
                    for at, state, put in insertions(audit, at, state):
                        place += 1
                        out.rows.append((conv, place, INSERT, put, "", None, *counts))
                    conv, audit, at, state, place = conv_id, new_audit, 0, START, 0
                    out.rows.append((conv, 0, None, None, None, audit, *head_counts))
                    continue
                for at, state, put in insertions(audit, at, state):
                    place += 1
                    out.rows.append((conv, place, INSERT, put, "", None, *counts))
                edit, at = audit[at], at + 1
                if edit == DELETE:
                    continue
                kept = role
                if edit == KEEP:
                    state = KEEPS[state][role[:1]]
                else:
                    state, kept = PUT_IN[state]
                place += 1
                out.rows.append((conv, place, edit, kept, text, None, *counts))
            if out.full():
                yield out.take()
    if out is not None:
        for _, _, put in insertions(audit, at, state):
            place += 1
            out.rows.append((conv, place, INSERT, put, "", None, *counts))
        yield out.take()


def _repaired(rows: DataFrame) -> DataFrame:
    """Per conversation, next to each other: a row at position 0 with audit and counts, then its repaired rows."""
    names = ("cost", *COUNTS)
    no_counts = [F.lit(None).cast("long").alias(c) for c in names]
    texts = _marked(rows).where("copies > 0").select(
        "conv_id", F.lit(False).alias("head"), "turn", "role", "key", "text", "copies",
        F.lit(None).cast("string").alias("audit"), *no_counts,
    )
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("turn", "long"), ("role", "string"), ("key", "string"), ("text", "string"), ("copies", "long"))]
    heads = audits(rows).select("conv_id", F.lit(True).alias("head"), *nothing, "audit", *names)
    both = heads.union(texts).repartition("conv_id")
    ordered = both.sortWithinPartitions("conv_id", F.desc("head"), "turn", "role", "key")
    given = ordered.select("conv_id", "head", "role", "text", "copies", "audit", *names)
    counted = ", ".join(f"{c} long" for c in names)
    fields = f"position long, edit string, role string, text string, audit string, {counted}"
    return given.mapInArrow(_edited, _struct(rows, fields))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text, edit)`` of the rows that repair leaves, inserted ones included.

    ``rows`` has ``conv_id, turn, role, text`` and may have ``copies``, the number of
    times a row stands there. A null role or text counts as one blank, null ids are one
    conversation, columns of other names play no part. No rows give no rows.
    """
    return _repaired(_counted(rows)).where("position > 0").select("conv_id", "position", "role", "text", "edit")


def _counted(rows: DataFrame) -> DataFrame:
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        _text("role").alias("role"),
        _text("text").alias("text"),
        copies.cast("long").alias("copies"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted repaired rows to one row per conversation, hashed as they go by."""
    out, head, digest = None, None, None
    for batch in batches:
        if out is None:
            kinds = [("conv_id", batch.schema.field(0).type), ("audit", pa.string()), ("cost", pa.int64())]
            out = _Batch([*kinds, *[(c, pa.int64()) for c in COUNTS], ("repaired_sha256", pa.string())])
        for conv_id, position, role, text, *rest in _records([batch]):
            if position:
                line = f"{role}:{text}" if position == 1 else f"\n{role}:{text}"
                digest.update(line.encode("utf-8", "replace"))
                continue
            if head is not None:
                out.rows.append((*head, digest.hexdigest()))
                if out.full():
                    yield out.take()
            head, digest = (conv_id, *rest), hashlib.sha256()
    if head is not None:
        out.rows.append((*head, digest.hexdigest()))
        yield out.take()


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts of its faults, cost and audit of the repair, digest of the result.

    Takes what ``repaired_turns`` takes; a conversation of no copies has zeros, an empty
    audit and the digest of nothing. SHA-256 goes through a text in one piece, so a
    conversation's rows pass one task in their order, which holds one batch of them.
    """
    rows = _counted(rows)
    given = _repaired(rows).select("conv_id", "position", "role", "text", "audit", "cost", *COUNTS)
    found = given.mapInArrow(_digests, _struct(rows, f"audit string, cost long, {_COUNTED}, repaired_sha256 string"))
    return found.select("conv_id", *COUNTS, "cost", "audit", "repaired_sha256")
