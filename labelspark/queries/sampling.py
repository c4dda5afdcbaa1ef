"""Samples, balanced classes, ranks and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark.operators import sampling as S
from labelspark.operators import splits as P
from labelspark.queries.labels import HASH_SPLIT_SQL
from labelspark.queries.registry import PRIORITY, STATUS, query, table
from labelspark.sources.tables import prepare_labelled

KEY = "o_orderkey"


@query("select o_orderkey, row_number() over (order by md5('42:' || o_orderkey), o_orderkey) - 1 as rank from orders")
def shuffle_rank(spark, folder):
    return S.shuffle_rank(table(spark, folder, "orders").select(KEY), KEY)


@query("""select o_orderkey, o_orderpriority from
            (select *, row_number() over (order by md5('42:' || o_orderkey), o_orderkey) as r from orders) where r <= 3000""")
def sample_size(spark, folder):
    return S.sample_rows(table(spark, folder, "orders"), size=3000, keys=KEY).select(KEY, PRIORITY)


@query("""select doc_id, lang, text from
            (select *, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) as r,
                    count(*) over (partition by lang) as c from documents)
          where r <= greatest(floor(c * 0.1::double), 1)""")
def sample_ratio(spark, folder):
    rows = S.sample_rows(table(spark, folder, "documents"), ratio=0.1, keys="doc_id", split_col="lang")
    return rows.select("doc_id", "lang", "text")


@query("""with keyed as (select *, md5('7:' || l_returnflag || ':' || l_linestatus) as h from lineitem),
               ranked as (select l_returnflag, l_linestatus, count(*) as c, min(h) as h from keyed group by 1, 2),
               placed as (select *, coalesce(sum(c) over (order by h rows between unbounded preceding and 1 preceding), 0) as b,
                                 floor(sum(c) over () * 0.4::double) as q from ranked)
          select l_returnflag, l_linestatus, cast(greatest(least(c, q - b), 0) as bigint) as n from placed where q > b""")
def sample_copies(spark, folder):
    """A sample of rows that are nearly all copies of each other."""
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus")
    kept = S.sample_rows(rows, ratio=0.4, seed=7)
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


BALANCE_SQL = """
with sizes as (select {by} o_orderpriority as p, count(*) as n from orders_split group by all),
     plan as (select {by} least(greatest(cast(floor({wanted}) as bigint), 1), min(n)) as picks from sizes {group}),
     ranked as (select *, row_number() over (partition by {by} o_orderpriority order by md5('0:' || o_orderkey), o_orderkey) as r
                from orders_split)
select o_orderkey, o_orderpriority {out} from ranked {join} where r <= picks"""
ONE_TABLE = {"by": "", "group": "", "out": "", "join": ", plan"}


def _balance_sql(wanted: str, **parts: str) -> str:
    return BALANCE_SQL.format(wanted=wanted, **(parts or ONE_TABLE)).replace("with ", "with orders_split as (select * from orders), ", 1)


@query(_balance_sql("200"))
def undersample_per_class(spark, folder):
    rows = S.balance_classes(table(spark, folder, "orders"), PRIORITY, samples_per_class=200, keys=KEY)
    return rows.select(KEY, PRIORITY)


@query(_balance_sql("sum(n)::double / count(*) * 0.3::double"))
def undersample_ratio(spark, folder):
    return S.balance_classes(table(spark, folder, "orders"), PRIORITY, ratio=0.3, keys=KEY).select(KEY, PRIORITY)


@query(_balance_sql("sum(n)::double / count(*) * (1400::double / sum(n))"))
def undersample_size(spark, folder):
    return S.balance_classes(table(spark, folder, "orders"), PRIORITY, size=1400, keys=KEY).select(KEY, PRIORITY)


@query(BALANCE_SQL.format(wanted="sum(n)::double / count(*) * 0.5::double", by="split,", group="group by split",
                          out=", split", join="join plan using (split)").replace(
    "with ", f"with orders_split as (select *, {HASH_SPLIT_SQL.format(key='o_orderkey')} as split from orders), ", 1))
def undersample_splits(spark, folder):
    rows = P.hash_split(table(spark, folder, "orders"), 0.2, KEY)
    return S.balance_classes(rows, PRIORITY, ratio=0.5, keys=KEY, split_col="split").select(KEY, PRIORITY, "split")


SPREAD_SQL = """
with ranked as (select *, row_number() over (partition by o_orderpriority order by {order}) - 1 as r,
                       count(*) over (partition by o_orderpriority) as m from orders),
     plan as (select {picks} as n)
select o_orderkey, o_orderpriority from ranked, plan
where n >= m or (n = 1 and r = 0) or (n > 1 and n < m and
      (((r * (n - 1) + m - 2) // (m - 1)) * (m - 1)) // (n - 1) = r)"""


@query(SPREAD_SQL.format(order="o_orderkey", picks="137::bigint"))
def undersample_spread(spark, folder):
    rows = S.balance_classes(table(spark, folder, "orders"), PRIORITY, samples_per_class=137, shuffle=False, order_cols=KEY)
    return rows.select(KEY, PRIORITY)


@query(SPREAD_SQL.format(
    order="o_orderstatus, md5('0:' || o_orderkey), o_orderkey",
    picks="""(select least(cast(floor(count(*)::double / (count(distinct o_orderpriority) + count(distinct o_orderstatus))
                     * 0.5::double) as bigint), (select min(c) from (select count(*) c from orders group by o_orderpriority)))
              from orders)"""))
def undersample_multilabel(spark, folder):
    rows = S.balance_classes(table(spark, folder, "orders"), [PRIORITY, STATUS], ratio=0.5, keys=KEY)
    return rows.select(KEY, PRIORITY)


@query("""select o_orderkey, case when r <= ceil(c * 0.1::double) then 'test' else 'train' end as split from
            (select o_orderkey, row_number() over (order by md5('42:' || o_orderkey), o_orderkey) as r, count(*) over () as c from orders)""")
def train_test_split(spark, folder):
    return P.random_split(table(spark, folder, "orders"), 0.1, KEY).select(KEY, "split")


@query(f"select doc_id, {HASH_SPLIT_SQL.format(key='doc_id')} as split from documents")
def hash_split(spark, folder):
    return P.hash_split(table(spark, folder, "documents"), 0.2, "doc_id").select("doc_id", "split")


@query("""select event_id, case when r <= floor(c * 0.8::double) then 'train' else 'test' end as split from
            (select event_id, row_number() over (order by ts, event_id) as r, count(*) over () as c from events)""")
def positional_split(spark, folder):
    return P.positional_split(table(spark, folder, "events"), 0.8, ["ts", "event_id"]).select("event_id", "split")


@query("""select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r, count(*) over () as n from orders)
          where r >= (n // 7) * 2 + least(2, n % 7) and r < (n // 7) * 3 + least(3, n % 7)""")
def shard(spark, folder):
    return P.shard(table(spark, folder, "orders"), 7, 2, KEY).select(KEY)


LOAD_SQL = """
with s as (select *, case when row_number() over (order by md5('42:' || o_orderkey), o_orderkey) <= ceil(count(*) over () * 0.2::double)
                     then 'test' else 'train' end as split from orders),
     sizes as (select split, o_orderpriority, count(*) as n from s group by all),
     plan as (select split, least(greatest(cast(floor(sum(n)::double / count(*) * 0.25::double) as bigint), 1), min(n)) as picks
              from sizes group by split),
     ranked as (select *, row_number() over (partition by split, o_orderpriority order by md5('42:' || o_orderkey), o_orderkey) as r from s)
select o_orderkey, split, 'user' as first_role, 'customer ' || o_custkey || ' ordered' as prompt, o_orderpriority as completion
from ranked join plan using (split) where r <= picks"""


@query(LOAD_SQL)
def load_balanced(spark, folder):
    """Clean, split, balance every split, convert to chat."""
    orders = table(spark, folder, "orders").withColumn(
        "text", F.concat(F.lit("customer "), F.col("o_custkey"), F.lit(" ordered")))
    chat, _ = prepare_labelled(orders, "text", PRIORITY, test_size=0.2, balanced=True, ratio=0.25, keys=KEY)
    m = F.col("messages")
    return chat.select(KEY, "split", m[0]["role"].alias("first_role"), m[0]["content"].alias("prompt"),
                       m[1]["content"].alias("completion"))
