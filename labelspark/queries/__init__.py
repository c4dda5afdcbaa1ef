"""The operators applied to the driver's tables, each with the same result in ANSI SQL."""

from labelspark.queries import chat, evaluation, files, labels, parsing, prompts, sampling
from labelspark.queries.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql", "chat", "evaluation", "files", "labels", "parsing", "prompts", "sampling"]
