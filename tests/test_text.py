"""Text measures against hand values and against plain Python on random strings."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from promptweave.functions import terms, text
from promptweave.functions.constants import COMPLEX_KEYWORDS, PUNCTUATION, WHITESPACE
from promptweave.operators.features import with_text_features

HAND = [
    ("", 0, 0, 0.0, 0.0, 0.0, 0, 0.0),
    (None, 0, 0, 0.0, 0.0, 0.0, 0, 0.0),
    ("   ", 3, 0, 0.0, 0.0, 0.0, 0, 0.0),
    ("aab b", 5, 2, 2.0, 1.0, 0.0, 0, 1.521928),
    ("Hi hi!", 6, 2, 2.5, 1.0, 0.166667, 0, 2.251629),
    ("The the", 7, 2, 3.0, 0.5, 0.0, 0, 2.235926),
    ("Explain, EXPLAIN explains explain_", 34, 4, 7.75, 1.0, 0.058824, 2, 3.990868),
]


def random_texts(n: int) -> list[str]:
    rng = random.Random(7)
    pieces = [
        *WHITESPACE, *PUNCTUATION, *"abcxyzABCXYZeE019_", *"éßñÜçſÉ", *"日本語", *"😀🎉",
        *COMPLEX_KEYWORDS, "EXPLAIN", "Design", "de", "the", "tree ", "queue ", "\r\n", "e ",
    ]
    return ["".join(rng.choices(pieces, k=rng.randrange(0, 60))) for _ in range(n)]


def syllables(word: str) -> int:
    letters = re.sub("e$", "", re.sub("[^a-z]", "", word.lower()))
    return max(1, len(re.findall("[aeiouy]+", letters)))


def expected(t: str) -> dict:
    words, size = t.split(), len(t)
    sentences = max(1, len(re.findall("[.!?]+", t)))
    flesch = 0.0
    if words:
        spoken = sum(map(syllables, words))
        flesch = 206.835 - 1.015 * len(words) / sentences - 84.6 * spoken / len(words)
    hits = re.findall(r"\b(?:" + "|".join(COMPLEX_KEYWORDS) + r")\b", t, re.IGNORECASE)
    return {
        "prompt_length": size,
        "word_count": len(words),
        "avg_word_len": sum(map(len, words)) / len(words) if words else 0.0,
        "unique_word_ratio": len(set(t.lower().split())) / len(words) if words else 0.0,
        "punctuation_ratio": sum(c in string.punctuation for c in t) / size if size else 0.0,
        "complex_keyword_count": len(hits),
        "char_entropy": -sum(k / size * math.log2(k / size) for k in Counter(t).values()),
        "flesch_reading_ease": flesch,
    }


def test_hand_rows(spark):
    names = list(text.TEXT_FEATURES)[:7]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(HAND)], "i int, user_prompt string")
    rows = with_text_features(df).orderBy("i").collect()
    for row, hand in zip(rows, HAND):
        for name, value in zip(names, hand[1:]):
            assert row[name] == pytest.approx(value, abs=1e-6), (hand[0], name)


def test_random_texts_match_python(spark):
    texts = random_texts(3000)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, user_prompt string")
    rows = with_text_features(df).orderBy("i").collect()
    for t, row in zip(texts, rows, strict=True):
        for name, value in expected(t).items():
            assert row[name] == pytest.approx(value, abs=1e-9), (t, name)


def test_single_measures_equal_the_staged_ones(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(300)], "user_prompt string")
    alone = [f("user_prompt").alias(f"alone_{n}") for n, f in text.TEXT_FEATURES.items()]
    both = with_text_features(df).select("*", *alone)
    unequal = [~F.col(n).eqNullSafe(F.col(f"alone_{n}")) for n in text.TEXT_FEATURES]
    for condition in unequal:
        assert both.where(condition).count() == 0


def test_strip_tokens_and_bigrams_match_python(spark):
    texts = random_texts(1500)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    stop = ("the", "de")
    rows = df.select(
        "i",
        text.strip("t").alias("stripped"),
        terms.tokens("t").alias("tokens"),
        terms.content_words("t", stop).alias("words"),
        terms.terms("t", stop).alias("terms"),
    ).orderBy("i").collect()
    for t, row in zip(texts, rows, strict=True):
        tokens = re.findall(r"\w{2,}", t.lower())
        words = [w for w in tokens if w not in stop]
        assert row["stripped"] == t.strip()
        assert row["tokens"] == tokens, t
        assert row["words"] == words
        assert row["terms"] == words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_stop_words_are_those_spark_ships(spark):
    from pyspark.ml.feature import StopWordsRemover

    from promptweave.functions.constants import ENGLISH_STOP_WORDS

    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_stop_words_with_quotes_are_quoted(spark):
    df = spark.createDataFrame([("it's o'clock",)], "t string")
    assert df.select(terms.tokens("t").alias("x")).first()["x"] == ["it", "clock"]
    assert df.select(terms.content_words("t", ("it's", "clock\\"))).first()[0] == ["it", "clock"]
    assert df.select(terms.content_words("t", ())).first()[0] == ["it", "clock"]


def test_one_long_run_of_a_character(spark):
    df = spark.range(1).select(F.repeat(F.lit("a"), 2_000_000).alias("t"))
    row = df.select(text.char_entropy("t"), text.word_count("t"), text.prompt_length("t")).first()
    assert tuple(row) == (0.0, 1, 2_000_000)


def test_entropy_of_texts_with_very_many_characters(spark):
    rng = random.Random(11)
    kinds = [[chr(c) for c in range(0x4E00, 0x4E00 + n)] for n in (63, 64, 65, 66, 500)]
    texts = ["".join(rng.choices(kind + ["😀"], k=3000)) for kind in kinds]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.orderBy("i").select(text.char_entropy("t")).collect()
    for t, row in zip(texts, rows, strict=True):
        assert row[0] == pytest.approx(expected(t)["char_entropy"], abs=1e-9)


def test_entropy_never_exceeds_log_of_distinct(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(500) if t], "t string")
    distinct = F.size(F.array_distinct(F.split("t", "")))
    over = df.where(text.char_entropy("t") > F.log2(distinct) + 1e-9)
    assert over.count() == 0


def test_preview_and_bar(spark):
    df = spark.createDataFrame([("é" * 100, 66.67), ("ab", 100.0), ("", 1.99)], "t string, p double")
    rows = df.select(text.preview("t"), text.percent_bar("p")).collect()
    assert [r[0] for r in rows] == ["é" * 80 + "...", "ab...", "..."]
    assert [r[1] for r in rows] == ["█" * 33 + "░" * 17, "█" * 50, "░" * 50]


def test_first_message(spark):
    from promptweave.functions.conversation import first_message, first_messages

    schema = "c array<struct<content:string,role:string>>"
    rows = [
        ([("a", None), ("b", None)],),
        ([],),
        (None,),
        ([(None, "user")],),
        ([("s", "system"), ("u", "user")],),
    ]
    found = spark.createDataFrame(rows, schema).select(first_message("c")).collect()
    assert [r[0] for r in found] == ["a", "", "", "", "s"]

    turns = [(1, 1, "later"), (1, 0, "first"), (2, 3, None), (2, 7, "x"), (3, 0, "")]
    long = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    got = {r["conv_id"]: r["user_prompt"] for r in first_messages(long).collect()}
    assert got == {1: "first", 2: "", 3: ""}
