"""Tokens, stop words and bigrams, written once as SQL.

The same text serves DataFrame code (through ``F.expr``) and the saved
pipeline (through ``SQLTransformer``), so training and scoring cannot drift.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptweave.functions.constants import ENGLISH_STOP_WORDS, WORD_CHARS


def sql_text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens_sql(col: str) -> str:
    """Lower-cased runs of two or more word characters; NULL text has none."""
    pattern = sql_text(f"[{WORD_CHARS}]{{2,}}")
    return f"regexp_extract_all(lower(coalesce(`{col}`, '')), {pattern}, 0)"


def content_words_sql(col: str, stop_words: Iterable[str]) -> str:
    listed = ", ".join(sql_text(w) for w in stop_words)
    if not listed:
        return tokens_sql(col)
    return f"filter({tokens_sql(col)}, w -> w NOT IN ({listed}))"


def bigrams_sql(words: str) -> str:
    """Neighbouring words joined by a space, for an array expression named ``words``."""
    return (
        f"array_compact(zip_with({words}, slice({words}, 2, size({words})), "
        "(a, b) -> a || ' ' || b))"
    )


def terms_sql(col: str, stop_words: Iterable[str]) -> str:
    """Unigrams and bigrams of one text.

    The words are bound once by the outer ``transform`` over a one-element
    array; written out in place they would be recomputed at each mention.
    """
    words = content_words_sql(col, stop_words)
    return f"transform(array({words}), ws -> concat(ws, {bigrams_sql('ws')}))[0]"


def tokens(col: str) -> Column:
    return F.expr(tokens_sql(col))


def content_words(col: str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    return F.expr(content_words_sql(col, stop_words))


def terms(col: str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    return F.expr(terms_sql(col, stop_words))
