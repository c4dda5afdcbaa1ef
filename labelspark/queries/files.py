"""Round trips through every source and sink, on whole tables in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.operators import metrics as M
from labelspark.operators.splits import hash_split
from labelspark.plans.config import RunConfig
from labelspark.queries.evaluation import (
    ANSWER_COLUMNS,
    ANSWER_TABLE_SQL,
    COUNTS_SQL,
    KEY,
    NAMES_SQL,
    REPORT_SQL,
    RUN_REPORT_SQL,
    VOCAB,
    order_counts,
    order_predictions,
    run_report,
)
from labelspark.queries.labels import HASH_SPLIT_SQL
from labelspark.queries.registry import ANSWERS_SQL, PRIORITY, query, table
from labelspark.session import checkpointed, scratch_path
from labelspark.sources import runs, tables


@query("""select doc_id, text as prompt, lang as completion from documents""")
def load_labelled_parquet(spark, folder):
    chat, _ = tables.load_labelled(spark, f"{folder}/documents.parquet", "text", "lang", keys="doc_id")
    m = F.col("messages")
    return chat.select("doc_id", m[0]["content"].alias("prompt"), m[1]["content"].alias("completion"))


@query("select doc_id, text, lang, source, n_chars from documents")
def csv_roundtrip(spark, folder):
    documents = table(spark, folder, "documents")
    path = scratch_path(spark, "documents.csv")
    tables.write_csv(documents, path)
    return tables.read_csv(spark, path, documents.schema)


@query("select cast(o_orderkey as varchar) as \"order key\", o_orderpriority as priority from orders")
def csv_skip_preamble(spark, folder):
    """Files that start with two title lines before the header."""
    orders = table(spark, folder, "orders")
    path = scratch_path(spark, "preamble.csv")
    part = F.spark_partition_id()
    body = orders.select(part.alias("file"), F.lit(1).alias("line"), F.monotonically_increasing_id().alias("at"),
                         F.to_csv(F.struct(KEY, PRIORITY)).alias("value"))
    titles = F.array(*[F.struct(F.lit(0).alias("line"), F.lit(i).cast("long").alias("at"), F.lit(t).alias("value"))
                       for i, t in enumerate(("Orders", "exported, all rows", '"order key",priority'))])
    head = body.select("file").distinct().select("file", F.inline(titles))
    lines = body.unionByName(head).repartition("file").sortWithinPartitions("file", "line", "at")
    lines.select("file", "value").write.partitionBy("file").text(path)
    return tables.read_csv_after(spark, path, 2, ["order key", "priority"])


@query(f"select o_orderkey, o_orderpriority, {HASH_SPLIT_SQL.format(key='o_orderkey')} as split from orders")
def split_sink(spark, folder):
    path = scratch_path(spark, "splits.csv")
    rows = hash_split(table(spark, folder, "orders").select(KEY, PRIORITY), 0.2, KEY)
    tables.write_splits(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@query(f"""with {ANSWERS_SQL} select o_orderkey, pred_id, true_id, cast(10 + o_orderkey % 7 + o_orderkey % 5 as int) as total_tokens,
             'Round trip' as technique_name, 16 as max_tokens, 12.5::double as total_time_elapsed from parsed""")
def run_json_roundtrip(spark, folder):
    out = scratch_path(spark, "out")
    config = RunConfig("Round trip", 16, "Choose a priority.")
    rows = order_predictions(spark, folder).select(KEY, "text", "truth", "response", "predicted", "actual")
    path = runs.run_folder(out, config.technique_name)
    runs.write_header(spark, config, VOCAB, 12.5, f"{path}/run")
    runs.write_samples(rows, f"{path}/samples")
    header = runs.read_headers(spark, f"{path}/run").first()
    samples = runs.read_samples(spark, f"{path}/samples", list(VOCAB), f"{KEY} long")
    return samples.select(
        KEY, F.col(f"predicted.{PRIORITY}").alias("pred_id"), F.col(f"actual.{PRIORITY}").alias("true_id"),
        F.col("response.total_tokens").alias("total_tokens"),
        F.lit(header.config.technique_name).alias("technique_name"), F.lit(header.config.max_tokens).alias("max_tokens"),
        F.lit(header.total_time_elapsed).alias("total_time_elapsed"))


@query("""with p as (select o_orderkey, cast(substr(o_orderpriority, 1, 1) as int) - 1 as t, o_orderpriority as c from orders)
          select 'r' || o_orderkey as run_id, 'old ' || o_orderkey % 3 as technique_name, 0 as sample_id, 'first' as text, c as answer,
                 0 as total_tokens, t as pred_id, t as true_id from p
          union all
          select 'r' || o_orderkey, 'old ' || o_orderkey % 3, 1, 'second', '{"a": "' || c || '"}', 7, t, 0 from p""")
def legacy_run_upgrade(spark, folder):
    """Run documents of an older layout: renamed field, bare answers, bare label lists."""
    true_id = F.substring(PRIORITY, 1, 1).cast("int") - 1
    texts = F.array(F.lit("first"), F.lit("second"))
    config = F.struct(F.concat(F.lit("old "), F.col(KEY) % 3).alias("name"), F.lit(8).alias("max_tokens"), F.lit(1).alias("unused"))
    record = F.to_json(F.struct(
        F.concat(F.lit('{"a": "'), F.col(PRIORITY), F.lit('"}')).alias("text"), F.lit(7).alias("total_tokens"), F.lit(0.5).alias("latency")))
    # The two kinds of response share an array, so the document is put together as text.
    document = F.concat(
        F.lit('{"run_id": "r'), F.col(KEY), F.lit('", "config": '), F.to_json(config),
        F.lit(', "texts": '), F.to_json(texts), F.lit(', "total_time_elapsed": 3.5, "total_tokens_per_response": null'),
        F.lit(', "label_names": '), F.to_json(F.lit(VOCAB[PRIORITY])),
        F.lit(', "labels_pred": '), F.to_json(F.array(true_id, true_id)),
        F.lit(', "labels_true": '), F.to_json(F.array(true_id, F.lit(0))),
        F.lit(', "llm_responses": ["'), F.col(PRIORITY), F.lit('", '), record, F.lit("]}"),
    )
    path = scratch_path(spark, "legacy")
    table(spark, folder, "orders").select(document.alias("value")).write.text(path)
    documents = runs.read_run_documents(spark, path, pretty=False, default_label=PRIORITY)
    names = runs.document_headers(documents).select("run_id", F.col("config.technique_name").alias("technique_name"))
    samples = runs.document_samples(documents, [PRIORITY])
    return samples.join(names, "run_id").select(
        "run_id", "technique_name", "sample_id", "text", F.col("response.text").alias("answer"),
        F.col("response.total_tokens").alias("total_tokens"),
        F.col(f"predicted.{PRIORITY}").alias("pred_id"), F.col(f"actual.{PRIORITY}").alias("true_id"))


ANSWER_SCHEMA = (f"{KEY} long, Text string, `LLM Response` string, `LLM Reasoning` string, `Prediction Time` double, "
                 f"`Total Tokens` int, `Predicted {PRIORITY}` string, `True {PRIORITY}` string")


@query(ANSWER_TABLE_SQL + " where pred_id <> true_id")
def report_sink(spark, folder):
    """A whole run written and its answers read back."""
    out = scratch_path(spark, "results")
    config = RunConfig("Known answers", 16, "Choose a priority.")
    report = M.classification_report(order_counts(spark, folder))
    path = runs.write_run(order_predictions(spark, folder), VOCAB, config, report, KEY, 12.5, out)
    back = tables.read_csv(spark, f"{path}/incorrect_answers.csv", ANSWER_SCHEMA).drop("LLM Reasoning")
    return back.withColumnsRenamed(ANSWER_COLUMNS)


@query(f"""with {RUN_REPORT_SQL} select run_id, 'o_orderpriority' as label_name, row_key, round(precision, 6) as precision,
             round(recall, 6) as recall, round(f1, 6) as f1, round(support, 6) as support from report""")
def report_scan(spark, folder):
    """Reports of many runs written in one job and read in one scan."""
    out = scratch_path(spark, "reports")
    runs.write_reports(run_report(spark, folder), [PRIORITY], out, run="run_id")
    back = runs.read_reports(spark, f"{out}/*")
    return back.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "support")})


RUN_FILES_SQL = f"""{COUNTS_SQL},{REPORT_SQL.format(by='', group='')},
named as (select {NAMES_SQL} as names),
given as (select o_orderkey, 'order ' || o_orderkey || ' of ' || o_custkey as text, names[pred_id + 1] as predicted, pred_id, true_id,
                 o_orderpriority as actual, (o_orderkey % 16) / 16 as latency, 10 + o_orderkey % 7 + o_orderkey % 5 as tokens from parsed, named)"""


@query(f"""with {RUN_FILES_SQL}
select 'run' as part, 'Known answers' as name, null as text, null as predicted, null as actual, 16.0::double as a, 12.5::double as b, null::double as c, null::double as d
union all select 'samples', cast(o_orderkey as varchar), text, cast(pred_id as varchar), cast(true_id as varchar), latency, tokens::double, null, null from given
union all select 'report', row_key, 'o_orderpriority', null, null, round(precision, 6), round(recall, 6), round(f1, 6), round(support, 6) from report
union all select 'answers', cast(o_orderkey as varchar), text, predicted, actual, latency, tokens::double, null, null from given
union all select 'incorrect', cast(o_orderkey as varchar), text, predicted, actual, latency, tokens::double, null, null from given where pred_id <> true_id""")
def run_sink(spark, folder):
    """A whole run written, and its five outputs read back."""
    rows = checkpointed(order_predictions(spark, folder))
    config = RunConfig("Known answers", 16, "Choose a priority.")
    report = M.classification_report(M.confusion_counts(rows, VOCAB))
    path = runs.write_run(rows, VOCAB, config, report, KEY, 12.5, scratch_path(spark, "results"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    names = ("part", "name", "text", "predicted", "actual", "a", "b", "c", "d")

    def part(df, *columns):
        return df.select(*[c.alias(n) for c, n in zip(columns, names)])

    parts = [
        part(runs.read_headers(spark, f"{path}/run"), F.lit("run"), F.col("config.technique_name"), text, text, text,
             F.col("config.max_tokens").cast("double"), F.col("total_time_elapsed"), number, number),
        part(runs.read_samples(spark, f"{path}/samples", list(VOCAB), f"{KEY} long"), F.lit("samples"), F.col(KEY).cast("string"), F.col("text"),
             F.col(f"predicted.{PRIORITY}").cast("string"), F.col(f"actual.{PRIORITY}").cast("string"), F.col("response.latency"),
             F.col("response.total_tokens").cast("double"), number, number),
        part(runs.read_reports(spark, path), F.lit("report"), F.col("row_key"), F.col("label_name"), text, text,
             *[F.round(c, 6) for c in ("precision", "recall", "f1", "support")]),
    ]
    for name, file in (("answers", "answers.csv"), ("incorrect", "incorrect_answers.csv")):
        parts.append(part(tables.read_csv(spark, f"{path}/{file}", ANSWER_SCHEMA), F.lit(name), F.col(KEY).cast("string"), F.col("Text"),
                          F.col(f"Predicted {PRIORITY}"), F.col(f"True {PRIORITY}"), F.col("Prediction Time"),
                          F.col("Total Tokens").cast("double"), number, number))
    return reduce(DataFrame.unionByName, parts)
