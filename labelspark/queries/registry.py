"""Registration of queries and the answer rule they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function, under its own name unless given, with SQL that gives the same rows."""

    def register(function):
        key = name or function.__name__
        _QUERIES[key] = function
        if sql is not None:
            _SQL[key] = sql
        return function

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Known classes of the two order labels, in vocabulary order.
PRIORITY, STATUS = "o_orderpriority", "o_orderstatus"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
UNKNOWN_PRIORITY = len(PRIORITIES)

# Every order stands for one model answer. The key says in which form the answer comes and
# whether it is wrong, so the ids a parser must find are known without parsing:
# forms 0-4 name a class (exact, lower case, cut off, number, after a wrong mention),
# forms 5-7 name none (other text, blanks, empty).
FORM = "o_orderkey % 8"
TARGET = (
    "((cast(substr(o_orderpriority, 1, 1) as int) - 1) + "
    "(case when floor(o_orderkey / 8) % 5 = 0 then 1 + o_custkey % 3 else 0 end)) % 5"
)
ANSWERS_SQL = f"""
answers as (
  select o.*, cast({FORM} as int) as form, cast({TARGET} as int) as target,
         cast(substr(o_orderpriority, 1, 1) as int) - 1 as true_id
  from orders o
),
parsed as (
  select *, case when form = 3 and target >= 4 then 5 when form <= 4 then target else 5 end as pred_id
  from answers
)"""


def order_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with ``text``, the model's ``answer`` and its token counts."""
    orders = table(spark, folder, "orders").withColumns(
        {"form": F.expr(f"cast({FORM} as int)"), "target": F.expr(f"cast({TARGET} as int)")})
    name = F.get(F.lit(PRIORITIES), F.col("target"))
    other = F.get(F.lit(PRIORITIES), (F.col("target") + 1) % 5)
    answer = (
        F.when(F.col("form") == 0, name)
        .when(F.col("form") == 1, F.lower(name))
        .when(F.col("form") == 2, F.substring(F.replace(name, F.lit(" "), F.lit("")), 1, 6))
        .when(F.col("form") == 3, F.col("target").cast("string"))
        .when(F.col("form") == 4, F.concat(F.lit("Surely not "), other, F.lit("; rather "), F.lower(name), F.lit(".")))
        .when(F.col("form") == 5, F.lit("no idea at all"))
        .when(F.col("form") == 6, F.lit(" \t "))
        .otherwise(F.lit(""))
    )
    return orders.withColumn("answer", answer).withColumn(
        "text", F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" of "), F.col("o_custkey")))


def with_response(answers: DataFrame) -> DataFrame:
    """The response record of each answer; the counts follow from the key."""
    key = F.col("o_orderkey")
    response = F.struct(
        F.col("answer").alias("text"),
        (10 + key % 7).cast("int").alias("prompt_tokens"),
        (key % 5).cast("int").alias("completion_tokens"),
        (10 + key % 7 + key % 5).cast("int").alias("total_tokens"),
        ((key % 16) / 16).alias("latency"),
        F.lit(None).cast("string").alias("reasoning"),
        F.lit(None).cast("string").alias("error"),
    )
    return answers.withColumn("response", response).withColumn("truth", F.col(PRIORITY))
