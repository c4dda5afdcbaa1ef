"""Answer parsing; the expected ids follow from the rule that made the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark.functions import answers as A
from labelspark.operators.labels import add_unknown, label_vocabulary
from labelspark.queries.registry import ANSWERS_SQL, PRIORITIES, PRIORITY, STATUS, STATUSES, order_answers, query, table

NAMES = [*PRIORITIES, A.UNKNOWN]
BOTH = {PRIORITY: NAMES, STATUS: [*STATUSES, A.UNKNOWN]}


def _matched(spark, folder, match):
    rows = order_answers(spark, folder)
    return rows.select("o_orderkey", match(F.col("answer"), NAMES).alias("class_id"))


@query(f"with {ANSWERS_SQL} select o_orderkey, case when form = 0 or (form = 2 and target in (1, 4)) then target end as class_id from parsed")
def parse_exact(spark, folder):
    return _matched(spark, folder, A.match_exact)


@query(f"with {ANSWERS_SQL} select o_orderkey, case when form = 3 then pred_id end as class_id from parsed")
def parse_numeric(spark, folder):
    return _matched(spark, folder, A.match_number)


@query(f"""with {ANSWERS_SQL} select o_orderkey, case when form <= 2 then target
             when form = 3 and target >= 1 then target - 1 when form >= 6 then 0 end as class_id from parsed""")
def parse_prefix(spark, folder):
    return _matched(spark, folder, A.match_prefix)


@query(f"""with {ANSWERS_SQL} select o_orderkey, case when form in (0, 1, 4) then target
             when form = 2 and target in (1, 4) then target end as class_id from parsed""")
def parse_last_mention(spark, folder):
    return _matched(spark, folder, A.match_last_mention)


@query(f"with {ANSWERS_SQL} select o_orderkey, pred_id as class_id from parsed")
def parse_single(spark, folder):
    return _matched(spark, folder, A.parse_answer)


@query(f"""with {ANSWERS_SQL} select o_orderkey, case when form = 3 then target else pred_id end as class_id from parsed""")
def parse_single_lenient(spark, folder):
    return _matched(spark, folder, lambda c, names: A.parse_answer(c, names, strict_numeric=False))


MANY_SQL = """with ids as (select c_custkey, c_name, cast(row_number() over (order by c_name) - 1 as int) as id, count(*) over () as v from customer),
     given as (select o_orderkey, c_name, id, cast(v as int) as v, o_orderkey % 6 as form from orders join ids on c_custkey = o_custkey)"""


@query(MANY_SQL + """
select o_orderkey, case form when 0 then id when 1 then id when 2 then case when id < v - 1 then id else v end when 3 then 0 when 4 then 0 else v end
       as class_id from given""")
def parse_many_classes(spark, folder):
    """Every customer is a class: named exactly, in a sentence, by a padded number, cut off, twice, or not at all."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    vocab = label_vocabulary(customers.withColumnRenamed("c_name", "customer"), "customer")
    (lowest,) = vocab.where("class_id = 0").select("class_name").first()
    classes = customers.join(vocab, customers.c_name == vocab.class_name).select("c_custkey", "c_name", "class_id")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    rows = orders.join(classes, orders.o_custkey == classes.c_custkey)
    form, name, first = F.col("o_orderkey") % 6, F.col("c_name"), F.lit(lowest.lower())
    answer = (
        F.when(form == 0, name).when(form == 1, F.concat(F.lit("I would say "), F.lower(name), F.lit(".")))
        .when(form == 2, F.lpad(F.col("class_id").cast("string"), 12, "0")).when(form == 3, F.lit(lowest[:9].upper()))
        .when(form == 4, F.concat(F.lit("First "), name, F.lit(", then "), first)).otherwise(F.lit("nobody"))
    )
    parsed = A.with_class_ids(rows.withColumn("answer", answer), "answer", add_unknown(vocab), "ids", labels="customer")
    return parsed.select("o_orderkey", F.col("ids.customer").alias("class_id"))


# Words to look for in running text, shared by Spark and SQL; the last one stands for unknown.
WORDS = ["the", "dans", "und", "el", "tion", "Unknown"]


@query("""with m as (select doc_id, regexp_extract_all(lower(text), '(?i)the|dans|und|el|tion|unknown') as hits from documents)
          select doc_id, cast(case when len(hits) = 0 then 5
                 else list_position(['the', 'dans', 'und', 'el', 'tion', 'unknown'], hits[-1]) - 1 end as int) as class_id from m""")
def parse_documents(spark, folder):
    """The last class named anywhere in whole documents."""
    documents = table(spark, folder, "documents")
    found = F.coalesce(A.match_last_mention(F.col("text"), WORDS), F.lit(len(WORDS) - 1))
    return documents.select("doc_id", found.alias("class_id"))


# The first long word and the first two words of each document are names; blanks in a name may be left out.
NAMED = ("[a-z]{8,}", "[a-z]{4,} [a-z]{4,}")


@query(f"""
with given as (select unnest([regexp_extract(lower(text), '{NAMED[0]}'), regexp_extract(lower(text), '{NAMED[1]}')]) as name from documents),
     names as (select name, row_number() over (order by name) - 1 as id from (select distinct name from given where name <> '')),
     pattern as (select string_agg(replace(name, ' ', ' *'), '|' order by id) as p from names),
     found as (select doc_id, regexp_extract_all(lower(text), p) as hits from documents, pattern),
     plain as (select replace(name, ' ', '') as plain, min(id) as id from names group by 1)
select doc_id, cast(id as int) as class_id from found left join plain on plain.plain = replace(hits[-1], ' ', '')""")
def mentions_in_documents(spark, folder):
    """The last of many names, taken from the documents, that each whole document mentions."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    names = F.array(*[F.regexp_extract(F.lower("text"), p, 0) for p in NAMED])
    vocab = label_vocabulary(documents.select(F.explode(names).alias("name")).where("name <> ''"), "name")
    return A.last_mentions(documents, "text", vocab, "name", "class_id").select("doc_id", "class_id")


def json_answers(spark, folder):
    """Orders with a JSON answer for two labels; the form follows from the key."""
    p, s = F.col(PRIORITY), F.col(STATUS)
    form = (F.col("o_orderkey") % 8).cast("int")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pair = lambda a, x, b, y: F.concat(F.lit(f'{{"{a}": '), x, F.lit(f', "{b}": '), y, F.lit("}"))
    valid = pair(PRIORITY, q(p), STATUS, q(s))
    answer = (
        F.when(form == 0, valid)
        .when(form == 1, F.concat(F.lit("I would say\n"), valid, F.lit(" is right {really}.")))
        .when(form == 2, pair("priority", q(F.lower(p)), STATUS, q(s)))
        .when(form == 3, F.concat(F.lit(f'{{"{STATUS}": '), q(s), F.lit("}")))
        .when(form == 4, F.replace(valid, F.lit('"'), F.lit("'")))
        .when(form == 5, F.concat(F.lit(f'{{"{PRIORITY}": "x", "{PRIORITY}": '), q(p), F.lit(f', "{STATUS}": null}}')))
        .when(form == 6, pair(PRIORITY, q(p), STATUS, F.lit("")))
        .otherwise(F.lit("[1, 2]"))
    )
    return table(spark, folder, "orders").withColumn("answer", answer)


MULTI_SQL = f"""
with v as (select o_orderkey, cast(o_orderkey % 8 as int) as form, cast(substr(o_orderpriority, 1, 1) as int) - 1 as p,
                  case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as s from orders)
select o_orderkey, case when form in (0, 1, 2, 5) then p else 5 end as priority_id,
       case when form in (0, 1, 2, 3) then s when form = 5 then 1 else 3 end as status_id from v"""


@query(MULTI_SQL)
def parse_multi(spark, folder):
    rows = A.with_class_ids(json_answers(spark, folder), "answer", BOTH, "ids")
    return rows.select("o_orderkey", F.col(f"ids.{PRIORITY}").alias("priority_id"), F.col(f"ids.{STATUS}").alias("status_id"))


@query("""select o_orderkey, cast(substr(o_orderpriority, 1, 1) as int) - 1 as priority_id,
                 case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as status_id from orders""")
def parse_multi_repair(spark, folder):
    """Both fields misnamed: found by their position."""
    answer = F.concat(F.lit('{"a": "'), F.col(PRIORITY), F.lit('", "b": "'), F.col(STATUS), F.lit('"}'))
    rows = A.with_class_ids(table(spark, folder, "orders").withColumn("answer", answer), "answer", BOTH, "ids")
    return rows.select("o_orderkey", F.col(f"ids.{PRIORITY}").alias("priority_id"), F.col(f"ids.{STATUS}").alias("status_id"))


@query("""with v as (select p_brand, cast(row_number() over (order by p_brand) - 1 as int) as id from (select distinct p_brand from part))
          select p_partkey, id as class_id from part join v using (p_brand)""")
def truth_ids(spark, folder):
    part = table(spark, folder, "part")
    vocab = add_unknown(label_vocabulary(part, "p_brand"))
    return A.with_class_ids(part, "p_brand", vocab, "ids", labels="p_brand").select("p_partkey", F.col("ids.p_brand").alias("class_id"))
