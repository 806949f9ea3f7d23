"""Prompts and chat texts, assembled in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks of the public ChatML format.
START, END = "<|im_start|>", "<|im_end|>"


def question_prompt(persona: Column, channel: Column, content: Column) -> Column:
    """What a model is asked for a query about a chunk."""
    return F.concat(
        F.lit("You write one search query as a person of this kind: "), persona,
        F.lit(".\nThe answer stands in this excerpt of the channel "), channel,
        F.lit(":\n\n"), content, F.lit("\n\nReply with the query alone."),
    )


def answer_prompt(query: Column, content: Column) -> Column:
    """What a model is asked to judge a pair by."""
    return F.concat(F.lit("Query: "), query, F.lit("\n\nExcerpt:\n"), content, F.lit('\n\nDoes the excerpt answer the query? Reply as {"valid": true or false, "reason": "..."}.'))


def chat_text(system: Column, user: Column) -> Column:
    """A system and a user message in ChatML, ready for the assistant's turn; both without outer white space."""
    turn = lambda role, body: F.concat(F.lit(f"{START}{role}\n"), F.trim(body), F.lit(f"{END}\n"))
    return F.concat(turn("system", system), turn("user", user), F.lit(f"{START}assistant\n"))
