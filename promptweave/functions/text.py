"""Text measures as native columns, with Python's idea of characters and words.

Whitespace is mapped to plain spaces once (``translate``); after that every
word rule is a cheap ASCII pattern. A character class over all 29 whitespace
characters gives the same words but costs about five times as much.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweave.functions.constants import (
    COMPLEX_KEYWORDS,
    PUNCTUATION,
    WHITESPACE,
    WORD_CHARS,
)

PEELS = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0.0 where there is nothing to divide by."""
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.trim(_col(c), F.lit(WHITESPACE))


def spaced(c: Column | str) -> Column:
    """The text with every whitespace character replaced by a plain space."""
    return F.translate(_col(c), WHITESPACE, " " * len(WHITESPACE))


def preview(c: Column | str, width: int = 80) -> Column:
    return F.concat(F.substring(_col(c), 1, width), F.lit("..."))


@dataclass(frozen=True)
class Parts:
    """A text and what several measures derive from it.

    Built from a column, the parts are nested expressions. ``staged`` puts them
    into columns of their own, so that measures side by side share them.
    """

    text: Column
    spaced: Column
    lower: Column
    words: Column
    sounded: Column

    @classmethod
    def of(cls, c: Parts | Column | str) -> Parts:
        if isinstance(c, Parts):
            return c
        text = _col(c)
        flat = spaced(text)
        lower = F.lower(flat)
        return cls(text, flat, lower, _words(lower), _sounded(lower))

    @classmethod
    def staged(cls, df: DataFrame, text: Column) -> tuple[DataFrame, Parts]:
        """``df`` with one temporary column per part; unused ones are pruned."""
        name = "__{}".format
        parts = cls(*[F.col(name(f)) for f in ("text", "spaced", "lower", "words", "sounded")])
        steps = {
            "text": text,
            "spaced": spaced(parts.text),
            "lower": F.lower(parts.spaced),
            "words": _words(parts.lower),
            "sounded": _sounded(parts.lower),
        }
        for part, expression in steps.items():
            df = df.withColumn(name(part), expression)
        return df, parts


def _words(lower: Column) -> Column:
    """Lower-case words; a blank text gives one empty word."""
    return F.split(F.trim(lower), " +")


def _sounded(lower: Column) -> Column:
    """Letters a-z and spaces only, less the final e of each word."""
    return F.regexp_replace(lower, r"[^a-z ]+|e(?=[^a-z ]*(?: |\z))", "")


def prompt_length(c: Parts | Column | str) -> Column:
    return F.length(Parts.of(c).text)


def word_count(c: Parts | Column | str) -> Column:
    words = Parts.of(c).words
    return F.size(words) - F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0)


def avg_word_len(c: Parts | Column | str) -> Column:
    parts = Parts.of(c)
    letters = F.length(F.replace(parts.spaced, F.lit(" "), F.lit("")))
    return _ratio(letters, word_count(parts))


def unique_word_ratio(c: Parts | Column | str) -> Column:
    parts = Parts.of(c)
    return _ratio(F.size(F.array_distinct(parts.words)), word_count(parts))


def punctuation_ratio(c: Parts | Column | str) -> Column:
    text = Parts.of(c).text
    size = F.length(text)
    return _ratio(size - F.length(F.translate(text, PUNCTUATION, "")), size)


def complex_keyword_count(
    c: Parts | Column | str, keywords: tuple[str, ...] = COMPLEX_KEYWORDS
) -> Column:
    """Whole-word hits, any case; ``keywords`` are plain words, not patterns."""
    pattern = rf"(?iu)(?<![{WORD_CHARS}])(?:{'|'.join(keywords)})(?![{WORD_CHARS}])"
    return F.regexp_count(Parts.of(c).text, F.lit(pattern))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _times_log2(k: Column) -> Column:
    return k * F.log2(k)


def _peel(left: Column, _: Column) -> Column:
    """Take every occurrence of the first character off what is left of a text."""
    rest = F.replace(left["rest"], F.left(left["rest"], F.lit(1)), F.lit(""))

    def state(r: Column, n: Column) -> Column:
        total = left["total"] + _times_log2(left["size"] - n)
        return F.struct(r.alias("rest"), n.alias("size"), total.alias("total"))

    peeled = _bound(rest, lambda r: _bound(F.length(r), lambda n: state(r, n)))
    return F.when(left["size"] == 0, left).otherwise(peeled)


def char_entropy(c: Parts | Column | str) -> Column:
    """Shannon entropy, in bits, of the code points of a text.

    It is ``log2(n) - sum(k * log2(k)) / n`` over the counts ``k`` of the
    characters. Most texts use few characters, and the frequent ones come
    early: taking all copies of the first character away, ``PEELS`` times, soon
    leaves nothing. What is left of a text with more characters is sorted, which
    puts equal ones side by side, and cut into runs. All of it happens inside
    the row: no id, no explode, no shuffle.
    """
    text = Parts.of(c).text
    size = F.nullif(F.length(text), F.lit(0))
    whole = F.struct(text.alias("rest"), F.length(text).alias("size"), F.lit(0.0).alias("total"))
    peeled = F.aggregate(F.sequence(F.lit(1), F.lit(PEELS)), whole, _peel)

    def with_runs(left: Column) -> Column:
        ordered = F.array_join(F.sort_array(F.split(left["rest"], "")), "")
        runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), F.lit(0))
        return F.aggregate(runs, left["total"], lambda total, r: total + _times_log2(F.length(r)))

    bits = F.log2(size) - _bound(peeled, with_runs) / size
    return F.greatest(F.coalesce(bits, F.lit(0.0)), F.lit(0.0))


def flesch_reading_ease(c: Parts | Column | str) -> Column:
    """Flesch (1948) reading ease for English; 0.0 when there are no words.

    Sentences: runs of ``.!?``, at least one. Syllables of a word: keep a-z,
    drop one final e, count vowel runs (y included), at least one. Both are
    counted over the whole text instead of word by word.
    """
    parts = Parts.of(c)
    words = word_count(parts)
    sentences = F.greatest(F.regexp_count(parts.text, F.lit("[.!?]+")), F.lit(1))
    vowel_runs = F.regexp_count(parts.sounded, F.lit("[aeiouy]+"))
    words_with_vowel = F.regexp_count(parts.sounded, F.lit("[aeiouy][^ ]*"))
    syllables = vowel_runs + words - words_with_vowel
    counted = F.nullif(words, F.lit(0)).cast("double")
    score = (
        F.lit(206.835)
        - F.lit(1.015) * (counted / sentences)
        - F.lit(84.6) * (syllables / counted)
    )
    return F.coalesce(score, F.lit(0.0))


def percent_bar(pct: Column | str, cells: int = 50) -> Column:
    """A bar of ``cells`` blocks, filled by whole shares of ``100 / cells`` percent."""
    filled = (_col(pct) / F.lit(100.0 / cells)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(cells) - filled))


STATISTICAL_FEATURES = {
    "prompt_length": prompt_length,
    "word_count": word_count,
    "avg_word_len": avg_word_len,
    "unique_word_ratio": unique_word_ratio,
    "punctuation_ratio": punctuation_ratio,
}

SEMANTIC_FEATURES = {
    "complex_keyword_count": complex_keyword_count,
    "char_entropy": char_entropy,
    "flesch_reading_ease": flesch_reading_ease,
}

TEXT_FEATURES = STATISTICAL_FEATURES | SEMANTIC_FEATURES
