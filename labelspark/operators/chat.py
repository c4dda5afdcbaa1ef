"""Labelled tables to chat records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.functions.json_text import json_object
from labelspark.functions.messages import exchange
from labelspark.functions.text import strip
from labelspark.operators.labels import decode_classes, label_vocabulary, select_text_labels
from labelspark.session import as_list, require_columns


def combine_columns(
    df: DataFrame, columns, new: str = "text", delete: bool = True, compact: bool = False
) -> DataFrame:
    """Columns as one JSON text column; the inputs go unless ``delete`` is off.

    The new column may carry the name of an input.
    """
    columns = as_list(columns)
    require_columns(df, columns)
    gone = set(columns) if delete else set()
    keep = [F.col(f"`{c}`") for c in df.columns if c != new and c not in gone]
    return df.select(*keep, json_object(df.schema, columns, compact).alias(new))


def to_messages(df: DataFrame, prompt: str, completion: str, keep=()) -> DataFrame:
    """Prompt/completion rows as a ``messages`` column."""
    kept = [F.col(f"`{c}`") for c in as_list(keep)]
    return df.select(*kept, exchange(F.col(f"`{prompt}`"), F.col(f"`{completion}`")).alias("messages"))


def preprocess_chat(
    df: DataFrame,
    text_cols,
    label_cols="label",
    encoded: DataFrame | None = None,
    keep=(),
    compact: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Labelled rows to chat records: ``(messages table, vocabulary)``.

    Several text or label columns are combined as JSON. ``encoded`` is the vocabulary of labels
    that hold class ids; plain string labels give the vocabulary themselves, over all splits.
    ``keep`` lists columns, such as the row key or the split, that go along with the messages.
    """
    texts, labels, keep = as_list(text_cols), as_list(label_cols), as_list(keep)
    keep = [k for k in keep if k not in texts and k not in labels]
    rows = select_text_labels(df, texts, labels, keep)
    vocab = label_vocabulary(rows, labels) if encoded is None else encoded
    if encoded is not None:
        rows = decode_classes(rows, labels, encoded)
    prompt = json_object(rows.schema, texts, compact) if len(texts) > 1 else F.col(f"`{texts[0]}`")
    answer = json_object(rows.schema, labels, compact) if len(labels) > 1 else F.col(f"`{labels[0]}`")
    messages = exchange(prompt.cast("string"), answer.cast("string")).alias("messages")
    return rows.select(*[F.col(f"`{k}`") for k in keep], messages), vocab


def conversation_messages(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Turn rows to whole conversations: ``(conversation, messages)``, in order of the turns.

    A conversation becomes one value and must fit a row. For its ends or its rendering no such value is
    needed: :func:`conversation_ends` and :func:`rendered_turns` work on turn rows.
    """
    entry = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    ordered = F.array_sort(F.collect_list(entry))
    messages = F.transform(ordered, lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content")))
    return turns.groupBy(F.col(conversation)).agg(messages.alias("messages"))


def conversation_ends(turns: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """``(conversation, first_text, last_text)``: the input and the expected answer of every conversation,
    combined before the shuffle whatever the length of a conversation."""
    return turns.groupBy(F.col(conversation)).agg(
        strip(F.min_by(text, turn)).alias("first_text"), F.max_by(text, turn).alias("last_text"))


def rendered_turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str, line) -> DataFrame:
    """``(conversation, turn, line)``: every turn as ``line`` renders one message. A conversation's text is its
    lines in order of the turns; no conversation is gathered."""
    m = F.struct(F.col(role).alias("role"), F.col(text).alias("content"))
    return turns.select(F.col(conversation), F.col(turn).alias("turn"), line(m).alias("line"))
