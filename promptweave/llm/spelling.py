"""Spelling variants: vocabulary acceptor, one-edit transducer and acceptor composed.

Two words one edit apart share their first half or their second half: with ``m`` code
points in the shorter one, the first ``m // 2`` or the last ``m - m // 2``. Each word is
routed to the states of the acceptor, read forwards or backwards, that these halves
lead to, and a state's words form a group. From that initial state a task composes the
minimised acceptor of what follows with the transducer and the acceptor again. Before
the edit both tapes are in one state, after it in two whose common endings are listed,
once per state however many beginnings lead there. The edit is taken at the first code
point that differs, so every pair comes up once, and a task returns numbers and best
neighbours per word, not pairs.

A group of very many words goes on by the place of the edit: words that are equal
without the code point there. Such a group has one word per letter at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweave.llm.common import join_checked
from promptweave.session import scratch_path

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
SLIP = 31
CROWD_WORDS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NEAR = "word string, near long, best_n long, best string"


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: runs of letters with A-Z lowered; one in 31, by a hash with its doc_id, lacks a letter.

    Only runs of ``min_length`` or more are cut out, as others give no word. A null text
    has no words, a null doc_id hashes as nothing.
    """
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))
    owner = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("owner")
    runs = docs.select(owner, F.explode(found).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    hashed = runs.select(lowered.alias("run"), F.crc32(F.concat("owner", F.lit(":"), lowered).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))
    return (
        words.where(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )


def _routes(words: DataFrame) -> DataFrame:
    """``(group, side, m, half, rest, n)``: each word under the halves it may share, ``rest`` read away from them."""
    size = F.length("word")

    def route(m: Column) -> list[Column]:
        first, last = F.floor(m / 2).cast("int"), F.ceil(m / 2).cast("int")
        front = F.struct(
            F.lit("p").alias("side"),
            m.alias("m"),
            F.substring("word", F.lit(1), first).alias("half"),
            F.substring("word", first + 1, size).alias("rest"),
        )
        back = F.struct(
            F.lit("s").alias("side"),
            m.alias("m"),
            F.substring("word", size - last + 1, size).alias("half"),
            F.reverse(F.substring("word", F.lit(1), size - last)).alias("rest"),
        )
        return [front, back]

    routed = words.select("n", F.explode(F.array(*route(size), *route(size - 1))).alias("r")).select("r.*", "n")
    return routed.withColumn("group", F.concat_ws(":", "side", "m", "half"))


class Acceptor:
    """Minimal acyclic acceptors of sorted words, over one set of states.

    A state is a number; equal right languages are one state, across all words added.
    """

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        self.ends: dict[tuple[int, int], tuple[str, ...]] = {}

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return state

    def add(self, words: list[str]) -> int:
        """The state whose right language is these words, which are sorted and distinct."""
        open_states: list[tuple[str, list]] = [("", [False, {}])]
        before = ""

        def close(depth: int) -> None:
            while len(open_states) > depth + 1:
                sign, (final, arcs) = open_states.pop()
                open_states[-1][1][1][sign] = self._state(final, arcs)

        for word in words:
            shared = len(commonprefix([before, word]))
            close(shared)
            open_states.extend((sign, [False, {}]) for sign in word[shared:])
            open_states[-1][1][0] = True
            before = word
        close(0)
        final, arcs = open_states[0][1]
        return self._state(final, arcs)

    def common(self, p: int, q: int) -> tuple[str, ...]:
        """What both right languages hold; looked for once per pair of states."""
        found = self.ends.get((p, q))
        if found is None:
            path: list[str] = []
            found, todo = [], [(0, "", p, q)]
            while todo:
                depth, sign, a, b = todo.pop()
                path[depth:] = [sign]
                if self.final[a] and self.final[b]:
                    found.append("".join(path))
                ours, theirs = self.arcs[a], self.arcs[b]
                if len(ours) > len(theirs):
                    ours, theirs = theirs, ours
                todo += [(depth + 1, s, ours[s], theirs[s]) for s in ours if s in theirs]
            found = self.ends[p, q] = tuple(found)
        return found


def compose(equal: list[str], longer: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart, each once: a code point replaced within ``equal``, or put in for ``longer``.

    ``equal`` are sorted distinct words of one length, ``longer`` such words with one
    code point more.
    """
    graph = Acceptor()
    first, second = graph.add(equal), graph.add(longer) if longer else None
    replaced: dict[int, list[tuple[str, str]]] = {}
    path: list[str] = []
    todo = [(0, "", first)]
    while todo:
        depth, sign, p = todo.pop()
        path[depth:] = [sign]
        arcs = sorted(graph.arcs[p].items())
        if p not in replaced:
            replaced[p] = [
                (a + end, b + end)
                for i, (a, to_a) in enumerate(arcs)
                for b, to_b in arcs[i + 1 :]
                for end in graph.common(to_a, to_b)
            ]
        if replaced[p]:
            start = "".join(path)
            yield from ((start + u, start + v) for u, v in replaced[p])
        todo += [(depth + 1, s, to) for s, to in arcs]
    if second is None:
        return
    inserted: dict[tuple[int, int], list[tuple[str, str]]] = {}
    todo = [(0, "", (first, second))]
    while todo:
        depth, sign, (p, q) = todo.pop()
        path[depth:] = [sign]
        if (p, q) not in inserted:
            inserted[p, q] = [
                (end, s + end) for s, to in graph.arcs[q].items() for end in graph.common(p, to) if end[:1] != s
            ]
        if inserted[p, q]:
            start = "".join(path)
            yield from ((start + u, start + v) for u, v in inserted[p, q])
        theirs = graph.arcs[q]
        todo += [(depth + 1, s, (to, theirs[s])) for s, to in graph.arcs[p].items() if s in theirs]


def _pairs(side: str, m: int, half: str, place: int | None, rests: dict[str, int]) -> Iterator[tuple[str, str]]:
    """Pairs of whole words among a group's rests, leaving those that another group has."""
    size = m - len(half)
    equal, longer = ([r for r in rests if len(r) == n] for n in (size, size + 1))
    if not equal or len(equal) + len(longer) < 2:
        return
    for u, v in compose(equal, longer):
        if place is not None and len(commonprefix([u, v])) != place:
            continue
        if side == "p":
            yield half + u, half + v
            continue
        u, v = u[::-1] + half, v[::-1] + half
        # A letter put in beside its like can be read from both ends; the front has it then.
        if len(commonprefix([u, v])) < m // 2:
            yield u, v


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and rest to number of near words and the best of them, per word."""
    now, rests = None, {}
    found: dict[str, list] = {}

    def note(word: str, other: str, n: int) -> None:
        held = found.setdefault(word, [0, -n, other])
        held[0] += 1
        held[1:] = min(held[1:], [-n, other])

    def close() -> None:
        if len(rests) < 2:
            return
        side, m, half, place = now
        counts = rests if side == "p" else {r[::-1]: n for r, n in rests.items()}
        cut = (lambda w: w[len(half) :]) if side == "p" else (lambda w: w[: len(w) - len(half)])
        for u, v in _pairs(side, m, half, place, rests):
            note(u, v, counts[cut(v)])
            note(v, u, counts[cut(u)])

    def rows() -> pa.RecordBatch:
        columns = list(zip(*[(w, c, -n, b) for w, (c, n, b) in found.items()], strict=True))
        found.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["word", "near", "best_n", "best"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for group, side, m, half, place, rest, n in zip(*columns, strict=True):
            if now is None or group != key:
                close()
                rests.clear()
                if len(found) > 4096:
                    yield rows()
                key, now = group, (side, m, half, place)
            rests[rest] = n
    if now is not None:
        close()
    if found:
        yield rows()


def near_words(words: DataFrame, crowd: int = CROWD_WORDS) -> DataFrame:
    """``(word, near, best_n, best)`` in parts, to be summed: near words of ``(word, n)`` rows, distinct and not null.

    ``crowd`` is the number of words above which a group goes on by the place of the edit.
    """
    routes = _routes(words)
    crowded = _kept(
        routes.groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") > crowd).select("group"), "crowds"
    )
    marked = join_checked(routes, crowded.withColumn("crowded", F.lit(True)), ["group"])
    plain = marked.where("crowded IS NULL").withColumn("place", F.lit(None).cast("int"))
    size = F.col("m") - F.length("half")
    # Where the edit may be: at each code point, or behind the last of the shorter word.
    places = marked.where("crowded").withColumn("place", F.explode(F.sequence(F.lit(0), size)))
    without = F.concat(F.expr("left(rest, place)"), F.expr("substring(rest, place + 2)"))
    # A replaced code point leaves equal remains; one put in leaves the shorter word as it is.
    ways = F.when(F.length("rest") > size, F.array(F.struct(F.lit("i").alias("way"), without.alias("left")))).otherwise(
        F.array(
            F.struct(F.lit("r").alias("way"), without.alias("left")),
            F.struct(F.lit("i").alias("way"), F.col("rest").alias("left")),
        )
    )
    dealt = places.withColumn("w", F.explode(ways)).withColumn(
        "group", F.concat_ws(":", "group", "place", "w.way", "w.left")
    )
    columns = ["group", "side", "m", "half", "place", "rest", "n"]
    both = plain.select(*columns).union(dealt.select(*columns))
    ordered = both.repartition("group").sortWithinPartitions("group", "rest")
    return ordered.mapInArrow(_near, _NEAR)


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for rows ``(word, form)``: each round doubles the steps taken.

    A form is at least ten times as frequent, so chains are short and end.
    """
    found = _kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("far"))
        stepped = _kept(
            found.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), "far"), "roots"
        )
        if stepped.where("far IS NOT NULL").isEmpty():
            return found
        found = stepped.drop("far")


def spelling_groups(words: DataFrame, ratio: int = FORM_RATIO, crowd: int = CROWD_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for rows ``(word, n)``, words distinct and not null.

    The form is the most frequent near word if it is at least ``ratio`` times as
    frequent, the first by code points among equals. An empty table gives no rows.
    """
    words = _kept(words.select("word", "n"), "words")
    none = F.lit(None).cast("long")
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("best_n"), none.cast("string").alias("best"))
    parts = near_words(words, crowd).select("word", none.alias("n"), "near", "best_n", "best")
    best = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    summed = own.union(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b"))
    enough = -F.col("b.less") >= ratio * F.col("n")
    formed = _kept(
        summed.select(
            "word",
            F.when(enough, F.col("b.best")).alias("form"),
            "n",
            "n_near",
            F.when(enough, -F.col("b.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_report(docs: DataFrame) -> DataFrame:
    """The spelling groups of the words of all texts; columns other than doc_id and text play no part."""
    return spelling_groups(vocabulary(docs))

