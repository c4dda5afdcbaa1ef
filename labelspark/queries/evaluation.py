"""Inference, metrics, error analysis and roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark.functions.answers import UNKNOWN
from labelspark.operators import errors as E
from labelspark.operators import metrics as M
from labelspark.operators import rollup as R
from labelspark.operators.chat import preprocess_chat
from labelspark.operators.labels import label_vocabulary, vocabulary_lists
from labelspark.operators.splits import hash_split, one_split
from labelspark.plans.bayes import classify_bayes, train_bayes
from labelspark.plans.config import RunConfig
from labelspark.plans.evaluate import evaluate, predictions, with_truth
from labelspark.plans.inference import failed, infer
from labelspark.plans.prompts import assemble_requests
from labelspark.queries.labels import HASH_SPLIT_SQL
from labelspark.queries.registry import ANSWERS_SQL, PRIORITIES, PRIORITY, order_answers, query, table, with_response
from labelspark.session import scratch_path

KEY = "o_orderkey"
VOCAB = {PRIORITY: [*PRIORITIES, UNKNOWN]}
NAMES_SQL = "['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'Unknown']"


def order_predictions(spark, folder):
    return predictions(with_response(order_answers(spark, folder)), VOCAB)


def order_counts(spark, folder):
    return M.confusion_counts(order_predictions(spark, folder), VOCAB)


def _in_runs(rows):
    return rows.withColumn("run_id", F.concat(F.lit("run"), F.col(KEY) % 4))


def run_predictions(spark, folder):
    """Four runs over the orders."""
    return _in_runs(order_predictions(spark, folder))


def run_responses(spark, folder):
    """The runs as they come from the model: counts and times need no parsed answer."""
    return _in_runs(with_response(order_answers(spark, folder)))


COUNTS_SQL = f"""{ANSWERS_SQL},
counts as (select true_id, pred_id, count(*) as n from parsed group by 1, 2)"""
REPORT_SQL = """
sides as (select {by} true_id as id, n as support, 0 as predicted, case when true_id = pred_id then n else 0 end as hits from counts
          union all select {by} pred_id, 0, n, 0 from counts),
cls as (select {by} id, sum(support)::double as support, sum(predicted) as predicted, sum(hits) as hits from sides group by all),
m as (select {by} id, support, hits, case when predicted > 0 then hits / predicted else 0 end as p,
             case when support > 0 then hits / support else 0 end as r, 2 * hits / (predicted + support) as f from cls),
report as (
  select {by} cast(id as varchar) as row_key, p as precision, r as recall, f as f1, support from m
  union all select {by} 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support) from m {group}
  union all select {by} 'macro avg', avg(p), avg(r), avg(f), sum(support) from m {group}
  union all select {by} 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) from m {group})"""


@query(f"""with {COUNTS_SQL},{REPORT_SQL.format(by='', group='')}
select 'o_orderpriority' as label_name, row_key, round(precision, 6) as precision, round(recall, 6) as recall,
       round(f1, 6) as f1, round(support, 6) as support from report""")
def classification_report(spark, folder):
    """The flagship: answers to classes, classes to a report."""
    report = M.classification_report(order_counts(spark, folder))
    return _rounded(report, "precision", "recall", "f1", "support")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"with {COUNTS_SQL} select 'o_orderpriority' as label_name, true_id, pred_id, n from counts")
def confusion_counts(spark, folder):
    return order_counts(spark, folder)


@query(f"""with {COUNTS_SQL} select 'o_orderpriority' as label_name, true_id, pred_id, n,
             round(n / sum(n) over (partition by true_id), 6) as ratio from counts""")
def confusion_matrix(spark, folder):
    return _rounded(M.confusion_matrix(order_counts(spark, folder)), "ratio")


@query(f"""with {COUNTS_SQL},
             ids as (select unnest(range(6)) as id), names as (select {NAMES_SQL} as names),
             grid as (select t.id as true_id, p.id as pred_id from ids t, ids p)
           select 'o_orderpriority' as label_name, cast(true_id as int) as true_id, cast(pred_id as int) as pred_id,
                  names[true_id + 1] as true_name, names[pred_id + 1] as pred_name, coalesce(n, 0) as n,
                  round(coalesce(n / sum(n) over (partition by true_id), 0), 6) as ratio, true as show_text
           from grid left join counts using (true_id, pred_id), names""")
def confusion_matrix_dense(spark, folder):
    return _rounded(M.dense_matrix(order_counts(spark, folder), VOCAB), "ratio")


@query(f"""with {ANSWERS_SQL}
select o_orderpriority as true_name, {', '.join(f'count(*) filter (pred_id = {i}) as "{n}"' for i, n in enumerate([*PRIORITIES, UNKNOWN]))}
from parsed group by 1""")
def confusion_matrix_pivot(spark, folder):
    return M.matrix_pivot(order_counts(spark, folder), PRIORITY, VOCAB[PRIORITY])


CUSTOMER_PAIRS_SQL = """ids as (select c_custkey, cast(row_number() over (order by c_name) - 1 as int) as id from customer),
     given as (select o_custkey as t, 1 + (o_custkey + o_orderkey % 3) % (select count(*) from customer) as p from orders),
     pairs as (select a.id as true_id, b.id as pred_id, count(*) as n
               from given join ids a on a.c_custkey = t join ids b on b.c_custkey = p group by 1, 2)"""


def _customer_counts(spark, folder):
    """The customers as a vocabulary, and orders given to a customer or one of the next two."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    vocab = label_vocabulary(customers.withColumnRenamed("c_name", "customer"), "customer")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    other = 1 + (F.col("o_custkey") + F.col("o_orderkey") % 3) % F.lit(customers.count())
    named = customers.join(vocab, customers.c_name == vocab.class_name).select("c_custkey", "class_id")
    rows = orders.withColumn("other", other).join(named.withColumnsRenamed({"c_custkey": "o_custkey", "class_id": "true_id"}), "o_custkey")
    rows = rows.join(named.withColumnsRenamed({"c_custkey": "other", "class_id": "pred_id"}), "other")
    ids = {side: F.struct(F.col(c).alias("customer")) for side, c in (("actual", "true_id"), ("predicted", "pred_id"))}
    return vocab, M.confusion_counts(rows.withColumns(ids), "customer")


@query(f"""with {CUSTOMER_PAIRS_SQL},
     cells as (select true_id, cast(sum(n) as bigint) as n, string_agg(pred_id || ':' || n, ',' order by pred_id) as cells from pairs group by 1)
     select 'customer' as label_name, id as true_id, coalesce(n, 0) as n, coalesce(cells, '') as cells
     from ids left join cells on true_id = id""")
def confusion_matrix_many(spark, folder):
    """A matrix over all customers."""
    vocab, counts = _customer_counts(spark, folder)
    found = M.matrix_rows(counts, vocab)
    entries = F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return found.select("label_name", "true_id", "n", F.array_join(entries, ",").alias("cells"))


@query(f"""with {CUSTOMER_PAIRS_SQL}
     select 'customer' as label_name, true_id // 64 * 64 as true_from, pred_id // 64 * 64 as pred_from, cast(sum(n) as bigint) as n,
            string_agg(true_id || ':' || pred_id || ':' || n, ',' order by true_id, pred_id) as cells
     from pairs group by 2, 3""")
def confusion_matrix_blocks(spark, folder):
    """The same matrix in squares of 64 customers."""
    _, counts = _customer_counts(spark, folder)
    cell = lambda c: F.concat_ws(":", *[c[f].cast("string") for f in ("true_id", "pred_id", "n")])
    return M.matrix_blocks(counts).withColumn("cells", F.array_join(F.transform("cells", cell), ","))


@query("""select sum(10 + o_orderkey % 7)::bigint as prompt_tokens, sum(o_orderkey % 5)::bigint as completion_tokens,
                 sum(10 + o_orderkey % 7 + o_orderkey % 5)::bigint as total_tokens, 'run' || o_orderkey % 4 as run_id
          from orders group by 4""")
def token_usage(spark, folder):
    return M.token_usage(run_responses(spark, folder), "run_id")


HEADER_SQL = "1000.0::double + (2 * cast(substr(run_id, 4) as int))"


def run_headers(spark, folder):
    """A header for each run found, and one for a run without results."""
    runs = run_responses(spark, folder).select("run_id").distinct()
    lost = runs.agg(F.concat(F.max("run_id"), F.lit("0")).alias("run_id"))
    number = F.substring("run_id", 4, 10).cast("int")
    config = F.struct(F.concat(F.lit("Classify as "), "run_id").alias("prompt"), (number + 32).alias("max_tokens"))
    return runs.unionByName(lost).select(
        "run_id", config.alias("config"), (F.lit(1000.0) + 2 * number).alias("total_time_elapsed"))


@query(f"""with c as (select 'run' || o_orderkey % 4 as run_id, count(*) as samples from orders group by 1)
           select run_id, samples, round(({HEADER_SQL}) / samples, 6) as latency from c""")
def latency_per_sample(spark, folder):
    return _rounded(M.latency_per_sample(run_headers(spark, folder), run_responses(spark, folder)), "latency")


@query("""select 'run' || o_orderkey % 4 as run_id, count(*) as samples, round(avg((o_orderkey % 16) / 16), 6) as mean_latency,
                 quantile_disc((o_orderkey % 16) / 16, 0.5) as median_latency from orders group by 1""")
def response_latency(spark, folder):
    rows = M.response_latency(run_responses(spark, folder), "run_id")
    return _rounded(rows, "mean_latency")


@query("""with s as (select 'run' || o_orderkey % 4 as run_id, sum((o_orderkey % 16) / 16) as seconds from orders group by 1)
          select run_id, cast(floor(seconds / 86400) as int) as days, cast(floor(seconds / 3600) as int) % 24 as hours,
                 cast(floor(seconds / 60) as int) % 60 as minutes, round(seconds - 60 * floor(seconds / 60), 6) as seconds from s""")
def elapsed_interval(spark, folder):
    seconds = F.sum(F.col("response.latency"))
    totals = run_responses(spark, folder).groupBy("run_id").agg(M.elapsed_interval(seconds).alias("elapsed"))
    part = lambda unit, kind: F.extract(F.lit(unit), F.col("elapsed")).cast(kind)
    return totals.select("run_id", part("DAY", "int").alias("days"), part("HOUR", "int").alias("hours"),
                         part("MINUTE", "int").alias("minutes"), part("SECOND", "double").alias("seconds"))


@query(f"""with {COUNTS_SQL} select 'o_orderpriority' as label_name, true_id, pred_id, n,
             cast(sum(n) over (partition by true_id) as bigint) as class_errors from counts where true_id <> pred_id""")
def error_pairs(spark, folder):
    return E.error_pairs(order_counts(spark, folder))


@query(f"""with {COUNTS_SQL},
             sides as (select 'true' as side, true_id as id, sum(n) as n from counts group by 2
                       union all select 'predicted', pred_id, sum(n) from counts group by 2),
             named as (select side, ({NAMES_SQL})[id + 1] as class_name, cast(n as bigint) as n from sides)
           select 'o_orderpriority' as label_name, side, class_name, n,
                  cast(row_number() over (partition by side order by n desc, class_name) as int) as rank from named""")
def true_vs_pred_distribution(spark, folder):
    return E.true_vs_predicted(order_counts(spark, folder), VOCAB)


ANSWER_COLUMNS = {"Text": "text", "LLM Response": "answer", "Prediction Time": "latency", "Total Tokens": "total_tokens",
                  f"Predicted {PRIORITY}": "predicted", f"True {PRIORITY}": "actual"}
ANSWER_TABLE_SQL = f"""with {ANSWERS_SQL}
select o_orderkey, 'order ' || o_orderkey || ' of ' || o_custkey as text,
       case form when 0 then t when 1 then lower(t) when 2 then substr(replace(t, ' ', ''), 1, 6) when 3 then cast(target as varchar)
            when 4 then 'Surely not ' || names[(target + 1) % 5 + 1] || '; rather ' || lower(t) || '.'
            when 5 then 'no idea at all' when 6 then ' ' || chr(9) || ' ' else '' end as answer,
       (o_orderkey % 16) / 16 as latency, cast(10 + o_orderkey % 7 + o_orderkey % 5 as int) as total_tokens,
       names[pred_id + 1] as predicted, o_orderpriority as actual
from (select *, names[target + 1] as t from parsed, (select {NAMES_SQL} as names))"""


def _answers(spark, folder, wrong_only):
    rows = E.answers(order_predictions(spark, folder), VOCAB, KEY, wrong_only)
    return rows.drop("LLM Reasoning").withColumnsRenamed(ANSWER_COLUMNS)


@query(ANSWER_TABLE_SQL)
def answers(spark, folder):
    return _answers(spark, folder, False)


@query(ANSWER_TABLE_SQL + " where pred_id <> true_id")
def incorrect_answers(spark, folder):
    return _answers(spark, folder, True)


FEW_SHOT_SQL = f"""{COUNTS_SQL},
errs as (select *, ({NAMES_SQL})[true_id + 1] as tn, ({NAMES_SQL})[pred_id + 1] as pn,
                sum(n) over (partition by true_id) as e from counts where true_id <> pred_id),
pairs as (select *, dense_rank() over (order by e desc, tn) as tr, row_number() over (partition by true_id order by n desc, pn) as pr from errs),
picked as (select p.o_orderkey, o_custkey, tn, pn, tr, pr,
                  row_number() over (partition by p.true_id, p.pred_id order by md5('0:' || p.o_orderkey), p.o_orderkey) as rr
           from parsed p join pairs q on p.true_id = q.true_id and p.pred_id = q.pred_id and tr <= 3 and pr <= 2)"""


def _few_shot(spark, folder):
    rows = order_predictions(spark, folder)
    return E.few_shot_examples(rows, M.confusion_counts(rows, VOCAB), VOCAB, KEY, per_class=3, per_true=2, per_pred=2)


@query(f"""with {FEW_SHOT_SQL}
select o_orderkey, tn as true_name, pn as pred_name, cast(tr as int) as true_rank, cast(pr as int) as pred_rank,
       cast(rr as int) as row_rank from picked where rr <= 2""")
def few_shot_mine(spark, folder):
    return _few_shot(spark, folder).select(KEY, "true_name", "pred_name", "true_rank", "pred_rank", "row_rank")


@query(f"""with {FEW_SHOT_SQL}
select string_agg('Example ' || i || ' - text: order ' || o_orderkey || ' of ' || o_custkey || chr(10) || 'correct result: ' || tn,
                  chr(10) || chr(10) order by tr, pr, rr) || chr(10) || chr(10) || 'Your turn - text: ' as examples
from (select *, row_number() over (order by tr, pr, rr) as i from picked where rr <= 2)""")
def few_shot_text(spark, folder):
    return E.few_shot_text(_few_shot(spark, folder), VOCAB)


@query("""select doc_id, quality as true_id, toxic as pred_id from documents join labels using (doc_id)""")
def join_predictions(spark, folder):
    """Predictions meet the truth by key, never by position."""
    graded = table(spark, folder, "labels")
    made = graded.select("doc_id", F.col("toxic").alias("pred_id"))
    truth = table(spark, folder, "documents").select("doc_id").join(graded.select("doc_id", F.col("quality").alias("true_id")), "doc_id")
    return with_truth(made, truth, "doc_id")


def language_rule():
    """A model that answers with the language whose commonest word occurs most."""
    words = {"en": " the ", "fr": " le ", "de": " der ", "es": " el "}

    def respond(messages, options):
        text = f" {messages[-1]['content'].lower()} "
        best = max(sorted(words), key=lambda lang: text.count(words[lang]))
        return {"text": best, "prompt_tokens": len(text), "completion_tokens": 1, "latency": 0.0}

    return respond


def length_rule():
    """A model that tells the parity of the text length and fails on every fifth length."""

    def respond(messages, options):
        n = len(messages[-1]["content"])
        if n % 5 == 0:
            raise ValueError("length")
        return {"text": "odd" if n % 2 else "even", "prompt_tokens": n, "completion_tokens": options["max_tokens"], "latency": 0.0}

    return respond


def _document_requests(spark, folder, config):
    return assemble_requests(table(spark, folder, "documents").select("doc_id", "text"), config)


@query("""with t as (select doc_id, ' ' || lower(text) || ' ' as t from documents),
               n as (select doc_id, length(t) as len, (length(t) - length(replace(t, ' der ', ''))) // 5 as de,
                            (length(t) - length(replace(t, ' the ', ''))) // 5 as en, (length(t) - length(replace(t, ' el ', ''))) // 4 as es,
                            (length(t) - length(replace(t, ' le ', ''))) // 4 as fr from t)
          select doc_id, 'rule' as run_id, case greatest(de, en, es, fr) when de then 'de' when en then 'en' when es then 'es' else 'fr' end as text,
                 cast(len + 1 as int) as total_tokens from n""")
def batch_infer(spark, folder):
    rows = infer(_document_requests(spark, folder, RunConfig("Rule", 4, "Name the language.")), language_rule)
    return rows.select("doc_id", "run_id", "response.text", "response.total_tokens")


@query("""select doc_id, 'parity' as run_id,
                 case when length(text) % 5 = 0 then '' when length(text) % 2 = 1 then 'odd' else 'even' end as answer,
                 cast(case when length(text) % 5 = 0 then 0 else length(text) end as int) as prompt_tokens,
                 cast(case when length(text) % 5 = 0 then 0 else length(text) + 4 end as int) as total_tokens from documents""")
def batch_infer_rule(spark, folder):
    rows = infer(_document_requests(spark, folder, RunConfig("Parity", 4)), length_rule, retries=1)
    r = F.col("response")
    return rows.select("doc_id", "run_id", r["text"].alias("answer"), r["prompt_tokens"].alias("prompt_tokens"),
                       r["total_tokens"].alias("total_tokens"))


@query("select doc_id, 'ValueError: length' as error from documents where length(text) % 5 = 0")
def batch_infer_errors(spark, folder):
    rows = infer(_document_requests(spark, folder, RunConfig("Parity", 4)), length_rule, retries=2, delay=0)
    return failed(rows).select("doc_id", F.col("response.error").alias("error"))


@query("""with r as (select case when length(trim(text, chr(9) || chr(10) || chr(13) || ' ')) % 2 = 1 then 1 else 0 end as odd,
                            length(trim(text, chr(9) || chr(10) || chr(13) || ' ')) % 5 = 0 as lost, quality, doc_id
                     from documents join labels using (doc_id))
          select doc_id, quality as true_id, cast(case when lost then 2 else odd end as int) as pred_id from r""")
def evaluate_end_to_end(spark, folder):
    """Documents graded even or odd by a rule, from chat records to ids."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    rows = rows.withColumn("grade", F.when(F.col("quality") == 1, "odd").otherwise("even"))
    chat, vocab = preprocess_chat(rows, "text", "grade", keep="doc_id")
    result, _ = evaluate(chat, vocabulary_lists(vocab, "grade"), RunConfig("Parity", 4), length_rule, "doc_id", retries=1)
    return result.select("doc_id", F.col("actual.grade").alias("true_id"), F.col("predicted.grade").alias("pred_id"))


def run_report(spark, folder):
    counts = M.confusion_counts(run_predictions(spark, folder), VOCAB, by="run_id")
    return M.classification_report(counts, by="run_id")


RUN_REPORT_SQL = f"""{ANSWERS_SQL},
counts as (select 'run' || o_orderkey % 4 as run_id, true_id, pred_id, count(*) as n from parsed group by all),
{REPORT_SQL.format(by='run_id,', group='group by run_id')},
avgs as (select run_id, avg(precision) filter (row_key = 'accuracy') as accuracy,
    {', '.join(f"avg({m}) filter (row_key = '{a} avg') as {m}_{a}" for a in ('macro', 'weighted') for m in ('precision', 'recall', 'f1'))}
  from report group by 1)"""
AVERAGES = ["accuracy", *[f"{m}_{a}" for a in ("macro", "weighted") for m in ("precision", "recall", "f1")]]
ROUNDED_SQL = ", ".join(f"round({c}, 6) as {c}" for c in AVERAGES)


@query(f"with {RUN_REPORT_SQL} select run_id, {ROUNDED_SQL} from avgs")
def report_rollup(spark, folder):
    return _rounded(R.average_metrics(run_report(spark, folder)), *AVERAGES)


@query(f"""with {RUN_REPORT_SQL},
  u as (select 'run' || o_orderkey % 4 as run_id, count(*) as samples, sum(10 + o_orderkey % 7)::bigint as prompt_tokens,
               sum(o_orderkey % 5)::bigint as completion_tokens, sum(10 + o_orderkey % 7 + o_orderkey % 5)::bigint as total_tokens
        from orders group by 1)
select run_id, prompt_tokens, completion_tokens, total_tokens, 'Classify as ' || run_id as prompt,
       cast(substr(run_id, 4) as int) + 32 as max_tokens, samples, round(({HEADER_SQL}) / samples, 6) as latency, {ROUNDED_SQL}
from u join avgs using (run_id)""")
def run_comparison(spark, folder):
    rows = R.run_comparison(run_headers(spark, folder), run_responses(spark, folder), run_report(spark, folder))
    return _rounded(rows, "latency", *AVERAGES)


@query("select max('run' || o_orderkey % 4) || '0' as run_id from orders")
def missing_runs(spark, folder):
    return R.missing_runs(run_headers(spark, folder), run_report(spark, folder))


def two_rules():
    """A model that answers two labels as an object: the parity of the text length and whether it is long."""

    def respond(messages, options):
        n = len(messages[-1]["content"])
        return {"text": f'Surely {{"length": "{"long" if n > 1000 else "short"}", "parity": "{"odd" if n % 2 else "even"}"}}', "latency": 0.0}

    return respond


@query("""with t as (select doc_id, length(trim(text, chr(9) || chr(10) || chr(13) || ' ')) as n, quality, toxic
                     from documents join labels using (doc_id))
          select doc_id, cast(case when n > 1000 then 0 else 1 end as int) as length_pred, cast(n % 2 as int) as parity_pred,
                 cast(case when quality = 1 then 0 else 1 end as int) as length_true, cast(toxic as int) as parity_true from t""")
def evaluate_multi_label(spark, folder):
    """Two labels from chat records to ids, with the answers written and read again."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    rows = rows.withColumn("length", F.when(F.col("quality") == 1, "long").otherwise("short"))
    rows = rows.withColumn("parity", F.when(F.col("toxic") == 1, "odd").otherwise("even"))
    chat, vocab = preprocess_chat(rows, "text", ["length", "parity"], keep="doc_id")
    lists = {"length": ["long", "short"], "parity": ["even", "odd"]}
    path = scratch_path(spark, "responses")
    result, _ = evaluate(chat, lists, RunConfig("Two rules", 8), two_rules, "doc_id", path=path, steps=3)
    return result.select("doc_id", *[F.col(f"{side}.{c}").alias(f"{c}_{name}") for side, name in (("predicted", "pred"), ("actual", "true")) for c in lists])


@query(f"""with d as (select lang, {HASH_SPLIT_SQL.format(key='doc_id')} as split from documents),
               ids as (select lang, row_number() over (order by lang) - 1 as id from (select distinct lang from documents where lang is not null))
          select cast(id as varchar) as row_key, cast(count(*) as double) as support from d join ids using (lang) where split = 'test' group by id""")
def train_predict_support(spark, folder):
    """Of the trained classifier's report what SQL can tell: how often each language was true."""
    report = train_predict(spark, folder)
    return report.where("row_key rlike '^[0-9]+$' and support > 0").select("row_key", "support")


TRAINED_SQL = f"""
with d as (select doc_id, lower(text) as text, lang, {HASH_SPLIT_SQL.format(key='doc_id')} as split from documents),
     ids as (select lang, row_number() over (order by lang) - 1 as id from (select distinct lang from documents where lang is not null)),
     w as (select doc_id, split, lang, unnest(regexp_extract_all(text, '\\p{{L}}+')) as word from d),
     n as (select lang, word, count(*) as n from w where split = 'train' and lang is not null group by 1, 2),
     v as (select greatest(count(distinct word), 1) as v from n),
     classes as (select lang, count(*) as docs from d where split = 'train' and lang is not null group by 1),
     sized as (select lang, ln(docs / (sum(docs) over ())) as prior, ln(coalesce((select sum(n) from n where n.lang = c.lang), 0) + v) as width from classes c, v),
     known as (select doc_id, word, count(*) as k from w where split = 'test' and word in (select word from n) group by 1, 2),
     shared as (select doc_id, n.lang, sum(k * ln(n + 1)) as s from known join n using (word) group by 1, 2),
     lengths as (select doc_id, sum(k) as k from known group by 1),
     scores as (select d.doc_id, c.lang, round(prior + coalesce(s, 0) - coalesce(k, 0) * width, 6) as score
                from d cross join sized c left join shared x on x.doc_id = d.doc_id and x.lang = c.lang
                     left join lengths y on y.doc_id = d.doc_id where split = 'test'),
     best as (select doc_id, lang as pred from scores qualify row_number() over (partition by doc_id order by score desc, lang) = 1),
     counts as (select coalesce(t.id, 4) as true_id, p.id as pred_id, count(*) as n
                from best join d using (doc_id) join ids p on p.lang = pred left join ids t on t.lang = d.lang group by 1, 2)"""


@query(f"""{TRAINED_SQL},{REPORT_SQL.format(by='', group='')}
select 'lang' as label_name, row_key, round(precision, 6) as precision, round(recall, 6) as recall,
       round(f1, 6) as f1, round(support, 6) as support from report""")
def train_predict(spark, folder):
    """A classifier of the document language, trained on counts of words and scored on held-out rows."""
    rows = hash_split(table(spark, folder, "documents"), 0.2, "doc_id")
    vocab = vocabulary_lists(label_vocabulary(rows, "lang"), "lang")
    model = train_bayes(one_split(rows, "train"), "text", "lang")
    test = one_split(rows, "test").withColumn("truth", F.col("lang"))
    scored = classify_bayes(model, test, "text", "doc_id", keep=["doc_id", "truth"])
    result = predictions(scored, {"lang": [*vocab["lang"], UNKNOWN]})
    report = M.classification_report(M.confusion_counts(result, ["lang"]))
    return _rounded(report, "precision", "recall", "f1", "support")
