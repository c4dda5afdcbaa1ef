"""Classification prompts from a vocabulary, and model requests from prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions.messages import MESSAGES_TYPE, message
from labelspark.plans.config import RunConfig
from labelspark.session import as_list

# Counts written as words; larger ones are written in digits.
COUNT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def count_word(n: int) -> str:
    return COUNT_WORDS[n] if n < len(COUNT_WORDS) else str(n)


def _class_lists(vocab: DataFrame) -> DataFrame:
    """Ordered class names per label; one row per label."""
    entries = F.array_sort(F.collect_list(F.struct("class_id", "class_name")))
    return vocab.groupBy("label_name").agg(F.transform(entries, lambda e: e["class_name"]).alias("names"))


def single_label_prompt(names: Column, item: str, step_by_step: bool = False) -> Column:
    """Prompt asking for one of the listed classes: the form of the answer, then a numbered list."""
    line = lambda n, i: F.concat(F.lit("\n("), (i + 1).cast("string"), F.lit(") "), n)
    thought = "Write down your reasons, and then, on a line of its own, " if step_by_step else "Write, without a further word, "
    return F.concat(
        F.lit(f"Which class does the {item} belong to? {thought}the name of one class as it is spelled in this list (say, "),
        F.get(names, F.lit(0)), F.lit("):\n"), F.array_join(F.transform(names, line), ""))


def multi_label_prompt(lists: dict[str, Column], item: str, step_by_step: bool = False) -> Column:
    """Prompt asking for a JSON object with one field per label: a line per field with its possible values."""
    n = count_word(len(lists))
    thought = "Write down your reasons, and then the object" if step_by_step else "Write the object, without a further word"
    parts: list[Column] = [F.lit(f"Fill a JSON object of {n} fields for the {item}. {thought}. Fields and their values:\n")]
    for label, names in lists.items():
        parts += [F.lit(f'\n"{label}" = '), F.array_join(F.transform(names, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " or ")]
    return F.concat(*parts)


def with_closing(prompt: Column, examples: Column | None, step_by_step: bool = False) -> Column:
    """Append worked examples, or a closing line where there are none."""
    line = F.lit("\n\nTake one step after the other." if step_by_step else "\n\nNow the item:")
    if examples is None:
        return F.concat(prompt, line)
    given = F.coalesce(F.length(examples) > 0, F.lit(False))
    return F.when(given, F.concat(prompt, F.lit("\n\n"), examples)).otherwise(F.concat(prompt, line))


def prompt_table(
    vocab: DataFrame, labels, item: str, step_by_step: bool = False, examples: str | Column | None = None
) -> DataFrame:
    """The prompt for a vocabulary as a one-row table ``(prompt)``."""
    labels = as_list(labels)
    lists = _class_lists(vocab).agg(*[
        F.first(F.when(F.col("label_name") == c, F.col("names")), ignorenulls=True).alias(f"_{i}")
        for i, c in enumerate(labels)
    ])
    if len(labels) == 1:
        body = single_label_prompt(F.col("_0"), item, step_by_step)
    else:
        body = multi_label_prompt({c: F.col(f"_{i}") for i, c in enumerate(labels)}, item, step_by_step)
    given = F.lit(examples) if isinstance(examples, str) else examples
    return lists.select(with_closing(body, given, step_by_step).alias("prompt"))


def build_prompt(vocab: DataFrame, labels, item: str, step_by_step: bool = False, examples: str | None = None) -> str:
    """The prompt as a string, ready for a ``RunConfig``."""
    return prompt_table(vocab, labels, item, step_by_step, examples).first().prompt


def request_messages(text: Column, prompt: Column, role: Column) -> Column:
    """The instruction, unless it is null or empty, followed by the user's text."""
    question = message("user", text)
    bare = F.coalesce(prompt == "", F.lit(True))
    return F.when(bare, F.array(question)).otherwise(F.array(message(role, prompt), question)).cast(MESSAGES_TYPE)


def assemble_requests(texts: DataFrame, configs, text: str = "text") -> DataFrame:
    """One request per row and configuration: ``run_id``, ``request`` and ``options`` are added.

    The configurations are literals of the plan, so no join is involved.
    """
    configs = [configs] if isinstance(configs, RunConfig) else list(configs)
    runs = F.array(*[c.as_column() for c in configs])
    rows = texts.withColumn("_config", F.explode(runs))
    request = request_messages(F.col(f"`{text}`"), F.col("_config.prompt"), F.col("_config.prompt_role"))
    return rows.select(*texts.columns, F.col("_config.run_id").alias("run_id"), request.alias("request"),
                       F.col("_config.options").alias("options"))
