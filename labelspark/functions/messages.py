"""Chat messages: ``array<struct<role string, content string>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark.functions.text import strip

# The marks of the two supported chat layouts.
CHATML_START = "<|im_start|>"
CHATML_END = "<|im_end|>"
ZEPHYR_ROLES = {"user": "<|user|>", "system": "<|system|>", "assistant": "<|assistant|>"}
ZEPHYR_END = "</s>"

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def message(role, content: Column) -> Column:
    """One chat message."""
    role = role if isinstance(role, Column) else F.lit(role)
    return F.struct(role.alias("role"), content.alias("content"))


def user_message(content: Column) -> Column:
    """A plain string as a one-message conversation."""
    return F.array(message("user", content))


def exchange(prompt: Column, completion: Column) -> Column:
    """A prompt/completion pair as a two-message conversation."""
    return F.array(message("user", prompt), message("assistant", completion))


def first_text(messages: Column) -> Column:
    """The input text of a conversation."""
    return strip(F.get(messages, F.lit(0)).getField("content"))


def last_text(messages: Column) -> Column:
    """The expected answer of a conversation."""
    return F.get(messages, F.size(messages) - 1).getField("content")


def chatml_turn(m: Column) -> Column:
    return F.concat(
        F.lit(CHATML_START), m.getField("role"), F.lit("\n"),
        m.getField("content"), F.lit(CHATML_END + "\n"),
    )


def zephyr_turn(m: Column) -> Column:
    """Messages with another role render as nothing."""
    mark = F.lit(None).cast("string")
    for role, tag in ZEPHYR_ROLES.items():
        mark = F.when(m.getField("role") == role, F.lit(tag)).otherwise(mark)
    line = F.concat(mark, F.lit("\n"), m.getField("content"), F.lit(ZEPHYR_END + "\n"))
    return F.coalesce(line, F.lit(""))


def render_chatml(messages: Column, open_answer: bool = False) -> Column:
    """Conversation as ChatML text, optionally ending in an open assistant turn."""
    body = F.array_join(F.transform(messages, chatml_turn), "")
    return F.concat(body, F.lit(CHATML_START + "assistant\n")) if open_answer else body


def render_zephyr(messages: Column, open_answer: bool = False) -> Column:
    """Conversation as Zephyr text, optionally ending in an open assistant turn."""
    body = F.array_join(F.transform(messages, zephyr_turn), "")
    return F.concat(body, F.lit(ZEPHYR_ROLES["assistant"] + "\n")) if open_answer else body
