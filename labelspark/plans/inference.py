"""Batch inference: any model behind one function, called inside Spark tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.session import as_list, scratch_path

RESPONSE_TYPE = (
    "struct<text:string,prompt_tokens:int,completion_tokens:int,total_tokens:int,"
    "latency:double,reasoning:string,error:string>"
)

# messages, options -> response fields; "text" is required, the others default to 0 or null.
Responder = Callable[[list[dict], dict], dict]


def model_options(options: dict) -> dict:
    """Sampling options for the model call; unset reasoning options are left out.

    The names are fixed values of the model interface.
    """
    call = {k: options.get(k) for k in ("max_tokens", "temperature", "top_p")}
    if options.get("reasoning_effort") is not None:
        call["reasoning_effort"] = options["reasoning_effort"]
    if options.get("thinking_tokens") is not None:
        call["thinking"] = {"type": "enabled", "budget_tokens": options["thinking_tokens"]}
    return call


def ask(respond: Responder, messages: list[dict], options: dict, retries: int, delay: float) -> dict:
    """One call with retries; a call that keeps failing gives an empty response with the error."""
    started, error = time.time(), None
    for attempt in range(max(retries, 1)):
        try:
            got = respond(messages, options)
            prompt_tokens = int(got.get("prompt_tokens") or 0)
            completion_tokens = int(got.get("completion_tokens") or 0)
            latency = got.get("latency")
            return {
                "text": got["text"],
                "prompt_tokens": prompt_tokens,
                "completion_tokens": completion_tokens,
                "total_tokens": int(got.get("total_tokens") or prompt_tokens + completion_tokens),
                "latency": float(time.time() - started if latency is None else latency),
                "reasoning": got.get("reasoning"),
                "error": None,
            }
        except Exception as e:  # noqa: BLE001 - any failure of the model is recorded, not raised
            error = f"{type(e).__name__}: {e}"
            if attempt < retries - 1:
                time.sleep(delay)
    return {
        "text": "", "prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0,
        "latency": float(time.time() - started), "reasoning": None, "error": error,
    }


def infer(
    requests: DataFrame,
    make_responder: Callable[[], Responder],
    retries: int = 3,
    delay: float = 60.0,
    partitions: int | None = None,
    calls: int = 1,
) -> DataFrame:
    """Add a ``response`` to every request.

    ``make_responder`` runs once per task and returns the function that calls the model, so a
    client or a loaded model is shared by all rows of a task. ``partitions`` spreads the
    requests evenly when the input files do not. A task has at most ``calls`` calls in flight; with more
    than one, the function is called from as many threads.
    """
    rows = requests.repartition(partitions) if partitions else requests
    carried = [f for f in rows.schema.fields if f.name not in ("request", "options")]
    response = T.StructField("response", T.DataType.fromDDL(RESPONSE_TYPE))
    schema = T.StructType([*carried, response])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        respond = make_responder()

        def reply(messages, options) -> dict:
            return ask(respond, [dict(m) for m in messages], model_options(options), retries, delay)

        with ThreadPoolExecutor(calls) as threads:
            for batch in batches:
                each = threads.map if calls > 1 else map
                out = batch.drop(columns=["request", "options"])
                out["response"] = list(each(reply, batch["request"], batch["options"]))
                yield out[[f.name for f in schema.fields]]

    return rows.mapInPandas(run, schema)


def infer_to(requests: DataFrame, make_responder, path: str, keys, steps: int = 8, **options) -> DataFrame:
    """Inference written to a table, so that nothing downstream asks the model again.

    The requests are dealt into ``steps`` by a hash of their keys, and each step commits its answers, so
    a run that breaks loses one step at most. Requests answered in ``path`` are skipped, failed ones are
    asked again. An answer belongs to its key and to a digest of request and options: another prompt
    is another request. The result holds the latest answer, one without an error if there is one, of
    the given requests and of no others. Keys are not null and tell requests apart.

    Requests and earlier answers are read once: what is to be asked is written by step to the shared folder, and a
    step reads its own part, spread over as many tasks as the cluster runs unless ``partitions`` says otherwise.
    """
    spark = requests.sparkSession
    marked = requests.withColumn("request_digest", F.sha2(F.to_json(F.struct("request", "options")), 256))
    names = [*as_list(keys), "request_digest"]
    marked = marked.withColumn("_step", F.pmod(F.xxhash64(*names), F.lit(steps)))
    done = _answered(spark, path)
    if done is None:
        marked = marked.withColumn("_answered", F.lit(False))
    else:
        good = done.where(F.col("response.error").isNull()).select(*names).distinct().withColumn("_hit", F.lit(True))
        marked = marked.join(good, names, "left").withColumn("_answered", F.col("_hit").isNotNull()).drop("_hit")
    dealt = scratch_path(spark, "requests")
    marked.write.partitionBy("_answered", "_step").parquet(dealt)
    schema = marked.schema
    waiting = spark.read.schema(schema).parquet(dealt).where(~F.col("_answered")).drop("_answered")
    options = {"partitions": spark.sparkContext.defaultParallelism, **options}
    for step in sorted(r[0] for r in waiting.select("_step").distinct().collect()):  # ``steps`` numbers at most
        answered = infer(waiting.where(F.col("_step") == step).drop("_step"), make_responder, **options)
        answered.withColumn("asked_at", F.lit(time.time_ns())).write.mode("append").parquet(path)
    store = _answered(spark, path)
    if store is None:  # no requests, and none before
        empty = infer(waiting.drop("_step"), make_responder, **options)
        return empty.select(*as_list(keys), *[c for c in empty.columns if c not in names])
    columns = [c for c in store.columns if c not in (*names, "asked_at")]
    best = F.max_by(F.struct(*columns), F.struct(F.col("response.error").isNull(), "asked_at"))
    given = spark.read.schema(schema).parquet(dealt).select(*names)
    rows = store.join(given, names, "left_semi")
    return rows.groupBy(*names).agg(best.alias("_row")).select(*as_list(keys), "_row.*")


def _answered(spark, path: str) -> DataFrame | None:
    """The answers in ``path``, None if no step has committed any. A store that cannot be read is an error: taking it
    for empty would ask, and pay, again."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/part-*")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files):
        return None
    return spark.read.parquet(path)


def failed(responses: DataFrame) -> DataFrame:
    """Rows whose model call failed."""
    return responses.where(F.col("response.error").isNotNull())
