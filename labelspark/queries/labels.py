"""Label operators on orders, parts, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark.functions.text import escape_prompt, normalise_label, slug, truncate_label
from labelspark.operators import labels as L
from labelspark.operators.splits import hash_split, one_split
from labelspark.queries.registry import PRIORITY, STATUS, query, table

BRAND, TYPE = "p_brand", "p_type"


def padded_orders(spark, folder):
    pad = lambda c: F.concat(F.lit("\t 　"), F.col(c), F.lit("  \n"))
    return table(spark, folder, "orders").withColumns({PRIORITY: pad(PRIORITY), STATUS: pad(STATUS)})


def graded_documents(spark, folder):
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return documents.join(labels, "doc_id", "left")


@query("select o_orderkey, o_orderpriority, o_orderstatus from orders")
def strip_labels(spark, folder):
    return L.strip_labels(padded_orders(spark, folder), [PRIORITY, STATUS]).select("o_orderkey", PRIORITY, STATUS)


@query("""select doc_id, text, quality, toxic from documents join labels using (doc_id)
          where text is not null and quality is not null and toxic is not null""")
def drop_null_rows(spark, folder):
    rows = L.drop_null_rows(graded_documents(spark, folder), "text", ["quality", "toxic"])
    return rows.select("doc_id", "text", "quality", "toxic")


@query("select text, source, lang from documents")
def select_text_labels(spark, folder):
    return L.select_text_labels(table(spark, folder, "documents"), "text", ["source", "lang"])


@query("select doc_id, text, source, lang, quality from documents join labels using (doc_id)")
def labelled_dataset(spark, folder):
    return L.labelled_dataset(graded_documents(spark, folder), "text", ["source", "lang", "quality"], extra=["doc_id"])


@query("""select p_partkey, p_brand, p_type from part
          where p_brand in ('Brand#4', 'Brand#25', 'Brand#13') and p_type in ('PROMO', 'SMALL')""")
def filter_class_list(spark, folder):
    rows = L.filter_classes(table(spark, folder, "part"),
                            {BRAND: ["Brand#4", "Brand#25", "Brand#13"], TYPE: ["PROMO", "SMALL"]})
    return rows.select("p_partkey", BRAND, TYPE)


@query("""select p_partkey, p_brand from part
          where p_brand in (select p_brand from part group by p_brand having count(*) > 80)""")
def min_class_size(spark, folder):
    return L.drop_rare_classes(table(spark, folder, "part"), BRAND, 80).select("p_partkey", BRAND)


@query("""with kept as (select * from part
            where p_brand in (select p_brand from part group by p_brand having count(*) > 80))
          select p_partkey, p_brand, p_type from kept
          where p_type in (select p_type from kept group by p_type having count(*) > 170)""")
def min_class_size_multilabel(spark, folder):
    part = table(spark, folder, "part")
    kept = L.drop_rare_classes(part, BRAND, 80)
    return L.drop_rare_classes(kept, TYPE, 170).select("p_partkey", BRAND, TYPE)


@query("""select d.doc_id, l.quality from documents d left join labels l using (doc_id)
          where l.quality is null or l.quality in (select quality from labels group by quality having count(*) > 100)""")
def min_class_size_nulls(spark, folder):
    rows = graded_documents(spark, folder).withColumn("quality", F.col("quality").cast("string"))
    kept = L.drop_rare_classes(rows, "quality", 100)
    return kept.select("doc_id", F.col("quality").cast("int").alias("quality"))


@query("select p_brand as class_name, count(*) as n from part group by p_brand having count(*) > 80")
def label_histogram_min(spark, folder):
    return L.label_histogram(table(spark, folder, "part"), BRAND, more_than=80)


@query("""select p_partkey, p_name, p_brand, p_type from part order by p_partkey limit 5""")
def head_projection(spark, folder):
    return L.head_rows(table(spark, folder, "part"), ["p_partkey", "p_name", BRAND, TYPE], "p_partkey")


@query("""select c_custkey, trim(n_name) as c_nationkey from customer
          left join nation on c_nationkey = n_nationkey""")
def class_decode(spark, folder):
    vocab = table(spark, folder, "nation").select(
        F.lit("c_nationkey").alias("label_name"), F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("class_name"))
    return L.decode_classes(table(spark, folder, "customer"), "c_nationkey", vocab).select("c_custkey", "c_nationkey")


@query("""with b as (select p_brand, row_number() over (order by p_brand) - 1 as id from (select distinct p_brand from part)),
               t as (select p_type, row_number() over (order by p_type) - 1 as id from (select distinct p_type from part))
          select p_partkey, cast(b.id as int) as p_brand, cast(t.id as int) as p_type
          from part join b using (p_brand) join t using (p_type)""")
def class_encode(spark, folder):
    return L.encode_classes(table(spark, folder, "part"), [BRAND, TYPE]).select("p_partkey", BRAND, TYPE)


@query("select doc_id, lang, source from documents")
def encode_decode_roundtrip(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source")
    vocab = L.label_vocabulary(documents, ["lang", "source"], strip_names=False)
    encoded = L.encode_classes(documents, ["lang", "source"], vocab)
    return L.decode_classes(encoded, ["lang", "source"], vocab, strip_names=False)


@query("""select 'lang' as label_name, lang as class_name, count(*) as n from documents where lang is not null group by lang
          union all
          select 'source', source, count(*) from documents where source is not null group by source""")
def label_counts(spark, folder):
    return L.class_counts(table(spark, folder, "documents"), ["lang", "source"])


@query("""select 'p_brand' as label_name, count(distinct p_brand) as n_classes from part
          union all select 'p_type', count(distinct p_type) from part
          union all select 'p_size', count(distinct p_size) from part""")
def distinct_classes(spark, folder):
    return L.distinct_classes(table(spark, folder, "part"), [BRAND, TYPE, "p_size"])


@query("""select 'event_type' as label_name, min(n) as n_rarest
          from (select count(*) as n from events where event_type is not null group by event_type)""")
def minority_class_size(spark, folder):
    return L.minority_class_size(table(spark, folder, "events"), "event_type")


HASH_SPLIT_SQL = "case when substr(md5('42:' || {key}), 1, 8) < '33333333' then 'test' else 'train' end"


@query(f"select {HASH_SPLIT_SQL.format(key='o_orderkey')} as split, count(*) as n from orders group by 1")
def split_sizes(spark, folder):
    return L.split_sizes(hash_split(table(spark, folder, "orders"), 0.2, "o_orderkey"), "split")


@query(f"select o_orderkey, o_orderpriority from orders where {HASH_SPLIT_SQL.format(key='o_orderkey')} = 'test'")
def split_select(spark, folder):
    rows = hash_split(table(spark, folder, "orders"), 0.2, "o_orderkey")
    return one_split(rows, "test").select("o_orderkey", PRIORITY)


@query("""with top as (select p_brand as class_name, count(*) as n from part group by 1 order by n desc, class_name limit 10)
          select class_name, n, min(n) over () as balanced from top""")
def total_vs_balanced(spark, folder):
    return L.total_vs_balanced(table(spark, folder, "part"), BRAND)


@query("""select 'o_orderpriority' as label_name, cast(row_number() over (order by o_orderpriority) - 1 as int) as class_id,
                 o_orderpriority as class_name from (select distinct o_orderpriority from orders)
          union all
          select 'o_orderstatus', cast(row_number() over (order by o_orderstatus) - 1 as int), o_orderstatus
          from (select distinct o_orderstatus from orders)""")
def label_vocabulary(spark, folder):
    return L.label_vocabulary(padded_orders(spark, folder), [PRIORITY, STATUS])


@query("""with top as (select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 10),
               ids as (select p_brand, row_number() over (order by p_brand) - 1 as id from top)
          select p_partkey, cast(id as int) as p_brand from part join ids using (p_brand)""")
def top_n_classes(spark, folder):
    kept = L.top_n_classes(table(spark, folder, "part"), 10, BRAND)
    return L.encode_classes(kept, BRAND).select("p_partkey", BRAND)


@query("""with c as (select c_custkey, cast(c_custkey * 7 % 1300 as varchar) as bucket from customer),
             n as (select bucket, row_number() over (order by count(*) desc, bucket) as r from c group by 1)
          select c_custkey, bucket from c join n using (bucket) where r <= 1100""")
def top_n_classes_many(spark, folder):
    """More classes than a window would rank in one task."""
    bucket = (F.col("c_custkey") * 7 % 1300).cast("string")
    rows = table(spark, folder, "customer").select("c_custkey", bucket.alias("bucket"))
    return L.top_n_classes(rows, 1_100, "bucket")


@query("""with n as (select least(10, count(distinct p_brand), count(distinct p_type)) as n from part),
               b as (select p_brand, row_number() over (order by count(*) desc, p_brand) as r from part group by 1),
               t as (select p_type, row_number() over (order by count(*) desc, p_type) as r from part group by 1)
          select p_partkey, p_brand, p_type from part join b using (p_brand) join t using (p_type), n
          where b.r <= n.n and t.r <= n.n""")
def top_n_classes_multilabel(spark, folder):
    return L.top_n_classes(table(spark, folder, "part"), 10, [BRAND, TYPE]).select("p_partkey", BRAND, TYPE)


@query(f"""with s as (select *, {HASH_SPLIT_SQL.format(key='p_partkey')} as split from part),
               top as (select p_brand from s where split = 'train' group by 1 order by count(*) desc, p_brand limit 10)
          select p_partkey, p_brand, split from s where p_brand in (select p_brand from top)""")
def top_n_classes_splits(spark, folder):
    rows = hash_split(table(spark, folder, "part"), 0.2, "p_partkey")
    return L.top_n_classes(rows, 10, BRAND, split_col="split").select("p_partkey", BRAND, "split")


@query("select o_orderstatus, o_orderpriority, o_orderkey from orders")
def sort_by_labels(spark, folder):
    rows = L.sort_by_labels(table(spark, folder, "orders"), [STATUS, PRIORITY], "o_orderkey")
    return rows.select(STATUS, PRIORITY, "o_orderkey")


@query("""select p_partkey, regexp_replace(replace(trim(lower(p_name || ' ' || p_brand)), ' ', '_'), '[^a-z0-9_-]', '', 'g') as slug
          from part""", name="slug")
def slug_names(spark, folder):
    part = table(spark, folder, "part")
    return part.select("p_partkey", slug(F.concat_ws(" ", "p_name", BRAND)).alias("slug"))


@query("""select doc_id, replace(trim(lower(text), chr(9) || chr(10) || chr(13) || ' '), ' ', '') as squashed from documents""", name="normalise_label")
def normalise_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", normalise_label(F.col("text")).alias("squashed"))


@query("""select p_partkey, case when length(p_name || p_brand) > 15 then substr(p_name || p_brand, 1, 15) || '...'
                 else p_name || p_brand end as shown from part""", name="truncate_label")
def truncate_names(spark, folder):
    part = table(spark, folder, "part")
    return part.select("p_partkey", truncate_label(F.concat("p_name", BRAND)).alias("shown"))


@query("""select doc_id, replace(replace(text, chr(10), '\\n'), '"', '\\"') as one_line from documents""", name="escape_prompt")
def escape_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", escape_prompt(F.col("text")).alias("one_line"))
