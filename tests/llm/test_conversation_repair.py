"""Conversation repair against a search over all edits, and its edge cases."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from promptweave.llm.conversation_repair import damaged, repair_report, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, copies_made int, audit string, head boolean"
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    """Each conversation's rows after damage, in order."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        named = [" " if x is None else x for x in (conv, turn, role, text)]
        draw = zlib.crc32(f"{named[0]}:{named[1]}".encode()) % 20
        role, text = "user" if draw == 4 else named[2], named[3]
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(draw, text)
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    for kept in convs.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return convs


def search(rows):
    """Cost, audit and lines of the best repair of ``(role, text, fault)`` rows: cheapest first, then by audit."""
    todo, seen = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, at, state, lines = heapq.heappop(todo)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit, lines
        for sign, role in NAMES.items():
            if sign in NEXT[state]:
                heapq.heappush(todo, (cost + 3, audit + "I", at, NEXT[state][sign], (*lines, f"{role}:")))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(todo, (cost + 4, audit + "D", at + 1, state, lines))
        if fault in ("blank", "duplicate"):
            continue
        cost += 3 * (fault == "truncated")
        if role[:1] in NEXT[state]:
            heapq.heappush(todo, (cost, audit + "K", at + 1, NEXT[state][role[:1]], (*lines, f"{role}:{text}")))
        for sign, name in NAMES.items():
            if sign in NEXT[state]:
                heapq.heappush(todo, (cost + 3, audit + "R", at + 1, NEXT[state][sign], (*lines, f"{name}:{text}")))


def expected(rows):
    found = {}
    for conv, kept in damage(rows).items():
        seen, marked = set(), []
        for _, role, text in kept:
            shown = text.rstrip(WHITE)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" * (shown[-1] not in ".!?")
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = search(marked)
        found[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def best_by_table(rows):
    """Cost and audit of one conversation from a table of all rests and states, whole audits compared."""
    kept, seen, marked = damage(rows)[rows[0][0]], set(), []
    for _, role, text in kept:
        shown = text.rstrip(WHITE)
        gone = not shown or (role, text) in seen
        seen.add((role, text))
        marked.append((role[:1], gone, bool(shown) and shown[-1] not in ".!?"))
    best = [(0, ""), (6, "II"), (3, "I"), (0, "")]
    for initial, gone, cut in reversed(marked):
        now = []
        for state in range(4):
            options = [(4 + best[state][0], "D" + best[state][1])]
            for sign, to in NEXT[state].items():
                if not gone and sign != "s":
                    options.append((3 + 3 * cut + best[to][0], "R" + best[to][1]))
                if not gone and sign == initial:
                    options.append((3 * cut + best[to][0], "K" + best[to][1]))
            now.append(min(options))
        for _ in range(3):
            for state in range(4):
                to = 3 if state == 2 else 2
                now[state] = min(now[state], (3 + now[to][0], "I" + now[to][1]))
        best = now
    return best[0]


def report(spark, rows):
    df = spark.createDataFrame([(*r, 9, "audit", True) for r in rows], SCHEMA).repartition(3)
    return {r[0]: tuple(r)[1:] for r in repair_report(damaged(df)).collect()}


def test_equals_search(spark):
    draw = random.Random(5)
    texts = ["Fine.", "cut off", "Fine.", "  ", "Why?", "And é한!", "x" * 40_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "s"]
    rows = []
    for conv in [*range(150), None]:
        for _ in range(draw.randrange(0, 9)):
            turn = draw.choice([None, *range(8)])
            rows.append((conv, turn, draw.choice(roles), draw.choice([*texts, None])))
    rows += rows[:40]
    assert report(spark, rows) == expected(rows)


def test_long_and_shared(spark):
    """Thousands of equal conversations and one very long one."""
    shared = [(c, t, r, x) for c in range(1000, 3000) for t, r, x in ((0, "user", "Hi."), (1, "assistant", "Yes."), (2, "user", "No"))]
    long = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 900}.") for t in range(4000)]
    found = report(spark, shared + long)
    assert len(found) == 2001
    assert all(found[c] == expected([r for r in shared if r[0] == c])[c] for c in (1000, 1001, 1500, 2999))
    *_, duplicate, _, _, cost, audit, _ = found[1]
    assert duplicate > 2000 and audit.count("D") >= duplicate and cost >= 4 * duplicate
    assert (found[1][5], found[1][6]) == best_by_table(long)


def test_turns(spark):
    rows = [(7, 2, "assistant", "Yes.", 1), (7, 1, "user", "Hi.", 2), (7, 3, "assistant", "More", 1), (8, 1, "user", "x.", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long")
    found = sorted(tuple(r) for r in repaired_turns(df).collect())
    assert found == [
        (7, 1, "user", "Hi.", "K"),
        (7, 2, "assistant", "Yes.", "K"),
    ]
    report_rows = {r["conv_id"]: r for r in repair_report(df).collect()}
    assert report_rows[7]["audit"] == "KDKD" and report_rows[8]["audit"] == ""
    assert report_rows[8]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty(spark):
    assert report(spark, []) == {}


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_id_types(spark, kind):
    df = spark.createDataFrame([("5", 0, "user", "Hi."), (None, 0, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    found = repair_report(df.withColumn("conv_id", df["conv_id"].cast(kind)))
    assert found.schema["conv_id"].dataType.simpleString() == kind
    assert {str(r["conv_id"]) for r in found.collect()} == {"5", "None"}
