"""The opening message of a conversation, whoever sent it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_message(conversation: Column | str) -> Column:
    """First ``content`` of an array of messages; empty text where there is none."""
    messages = F.col(conversation) if isinstance(conversation, str) else conversation
    return F.coalesce(F.get(messages, F.lit(0))["content"], F.lit(""))


def first_messages(
    turns: DataFrame,
    conversation_id: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    out: str = "user_prompt",
) -> DataFrame:
    """The same for one row per message.

    Of messages with the same turn the smallest text counts, one without text
    before all. ``min_by`` keeps one candidate per conversation and map task,
    so a conversation of any length costs a bounded buffer.
    """
    opening = F.min_by(F.col(text), F.struct(turn, text))
    return turns.groupBy(conversation_id).agg(F.coalesce(opening, F.lit("")).alias(out))
