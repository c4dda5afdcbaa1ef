"""A whole evaluation: chat records in, predictions out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.functions.answers import with_class_ids, with_unknown
from labelspark.functions.messages import first_text, last_text
from labelspark.plans.inference import infer, infer_to
from labelspark.plans.prompts import assemble_requests
from labelspark.session import as_list, checkpointed


def predictions(
    responses: DataFrame, vocab: dict[str, list[str]], truth: str = "truth", strict_numeric: bool = True
) -> DataFrame:
    """Parse responses and true answers to ids: the columns ``predicted`` and ``actual`` are added.

    ``vocab`` ends with the unknown class. The true answer goes through the same parser.
    """
    rows = responses.withColumn("_answer", F.col("response.text"))
    rows = with_class_ids(rows, "_answer", vocab, "predicted", strict_numeric).drop("_answer")
    return with_class_ids(rows, truth, vocab, "actual", strict_numeric)


def with_truth(responses: DataFrame, truth: DataFrame, keys) -> DataFrame:
    """Responses beside the true answers of the same keys; rows are never matched by position."""
    return responses.join(truth, as_list(keys))


def evaluate(
    chat: DataFrame,
    vocab: dict[str, list[str]],
    configs,
    make_responder,
    keys,
    path: str | None = None,
    **options,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Ask a model about every record under every configuration and parse its answers.

    Returns the predictions, one row per record and run, and the vocabulary with the unknown
    class. Responses are written to ``path``, or the parsed predictions checkpointed, before they
    fan out into metrics: no model is asked twice.
    """
    keys = as_list(keys)
    names = with_unknown(vocab)
    texts = chat.select(*keys, first_text(F.col("messages")).alias("text"), last_text(F.col("messages")).alias("truth"))
    requests = assemble_requests(texts, configs)
    if path:
        responses = infer_to(requests, make_responder, path, [*keys, "run_id"], **options)
        return predictions(responses, names), names
    return checkpointed(predictions(infer(requests, make_responder, **options), names)), names
