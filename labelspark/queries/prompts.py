"""Prompts and requests with vocabularies taken from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark.operators.labels import add_unknown, label_vocabulary
from labelspark.plans import prompts as P
from labelspark.plans.config import RunConfig
from labelspark.queries.registry import PRIORITY, STATUS, query, table


@query("""with v as (select c, row_number() over (order by c) as i from (select distinct o_orderpriority as c from orders))
          select 'Which class does the order belong to? Write, without a further word, the name of one class as it is spelled in this list (say, ' ||
                 min(c) || '):' || chr(10) || string_agg(chr(10) || '(' || i || ') ' || c, '' order by c) ||
                 chr(10) || chr(10) || 'Now the item:' as prompt
          from v""")
def prompt_single(spark, folder):
    vocab = label_vocabulary(table(spark, folder, "orders"), PRIORITY)
    return P.prompt_table(vocab, PRIORITY, "order")


@query("""with p as (select string_agg('"' || c || '"', ' or ' order by c) as names from (select distinct o_orderpriority as c from orders)),
               s as (select string_agg('"' || c || '"', ' or ' order by c) as names from (select distinct o_orderstatus as c from orders))
          select 'Fill a JSON object of two fields for the order. Write the object, without a further word. Fields and their values:' || chr(10) ||
                 chr(10) || '"o_orderpriority" = ' || p.names || chr(10) || '"o_orderstatus" = ' || s.names ||
                 chr(10) || chr(10) || 'Now the item:' as prompt
          from p, s""")
def prompt_multi(spark, folder):
    vocab = label_vocabulary(table(spark, folder, "orders"), [PRIORITY, STATUS])
    return P.prompt_table(vocab, [PRIORITY, STATUS], "order")


@query("""with v as (select c, row_number() over (order by c) as i from (select distinct event_type as c from events))
          select 'Which class does the event belong to? Write down your reasons, and then, on a line of its own, ' ||
                 'the name of one class as it is spelled in this list (say, ' || min(c) || '):' || chr(10) ||
                 string_agg(chr(10) || '(' || i || ') ' || c, '' order by c) || chr(10) || chr(10) || 'text: ' || max(c) as prompt
          from v""")
def prompt_examples(spark, folder):
    vocab = label_vocabulary(table(spark, folder, "events"), "event_type")
    last = vocab.agg(F.max("class_name").alias("c")).first().c
    return P.prompt_table(vocab, "event_type", "event", step_by_step=True, examples=f"text: {last}")


CONFIGS = [
    RunConfig("Zero-shot", 32, "Name the language."),
    RunConfig("As user", 64, "Name the language.", prompt_role="user", reasoning_effort="low"),
    RunConfig("Fine-tuned", 8, None),
]


@query("""select doc_id, 'zero-shot' as run_id, '[{"role":"system","content":"Name the language."},{"role":"user","content":' ||
                 cast(to_json(text) as varchar) || '}]' as request from documents""")
def assemble_requests(spark, folder):
    rows = P.assemble_requests(table(spark, folder, "documents").select("doc_id", "text"), CONFIGS[0])
    return rows.select("doc_id", "run_id", F.to_json("request").alias("request"))


@query("""select doc_id, run_id, head || cast(to_json(text) as varchar) || '}]' as request, max_tokens, effort
          from documents, (values
            ('zero-shot', '[{"role":"system","content":"Name the language."},{"role":"user","content":', 32, null),
            ('as_user', '[{"role":"user","content":"Name the language."},{"role":"user","content":', 64, 'low'),
            ('fine-tuned', '[{"role":"user","content":', 8, null)) r(run_id, head, max_tokens, effort)""")
def assemble_requests_multi(spark, folder):
    rows = P.assemble_requests(table(spark, folder, "documents").select("doc_id", "text"), CONFIGS)
    return rows.select("doc_id", "run_id", F.to_json("request").alias("request"),
                       F.col("options.max_tokens").alias("max_tokens"), F.col("options.reasoning_effort").alias("effort"))


@query("""with v as (select p_brand as c from part group by 1)
          select cast(row_number() over (order by c) - 1 as int) as class_id, c as class_name from v
          union all select cast((select count(*) from v) as int), 'Unknown'""")
def vocab_with_unknown(spark, folder):
    vocab = label_vocabulary(table(spark, folder, "part"), "p_brand")
    return add_unknown(vocab).select("class_id", "class_name")
