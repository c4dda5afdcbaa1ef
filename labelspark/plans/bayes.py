"""Naive Bayes as relations: counts per class and word, scores by joins and sums.

No weight reaches the driver. A document meets the words it shares with a class by a join; for all other classes
its score depends on its number of known words alone, so one class per number of training documents can be the
best of them, and those few are compared within the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.session import as_list, checkpointed, settle, small_rows

# A word is a run of letters, in lower case.
WORD = r"\p{L}+"


@dataclass(frozen=True)
class BayesModel:
    """``words (word, class_name, weight)`` and ``classes (class_name, docs, size, prior, width)``."""

    words: DataFrame
    classes: DataFrame


def _words(text: str) -> Column:
    return F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(WORD), F.lit(0))).alias("word")


def train_bayes(train: DataFrame, text: str, label: str) -> BayesModel:
    """Fit on the rows with a label: word counts with one added, and shares of the classes.

    Counts are combined in the tasks before they are shuffled; a null or empty text counts for its class only.
    """
    rows = train.select(F.col(f"`{label}`").cast("string").alias("class_name"), F.col(f"`{text}`").alias("text")).where("class_name is not null")
    counts = checkpointed(rows.select("class_name", _words("text")).groupBy("class_name", "word").agg(F.count("*").alias("n")))
    docs = rows.groupBy("class_name").agg(F.count("*").alias("docs"))
    sizes = counts.groupBy("class_name").agg(F.sum("n").alias("size"))
    distinct = max(counts.select("word").distinct().count(), 1)
    total = F.sum("docs").over(Window.partitionBy())
    classes = docs.join(sizes, "class_name", "left").select(
        "class_name", "docs", F.coalesce("size", F.lit(0)).alias("size"), F.log(F.col("docs") / total).alias("prior"),
        F.log(F.coalesce("size", F.lit(0)) + distinct).alias("width"))
    return BayesModel(counts.select("word", "class_name", F.log(F.col("n") + 1).alias("weight")), checkpointed(classes))


def _front(classes: DataFrame) -> Column:
    """The classes that can be best without a shared word: more documents than all classes of fewer words."""
    order = Window.partitionBy().orderBy("size", F.desc("docs"), "class_name")
    more = F.col("docs") > F.coalesce(F.max("docs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = classes.withColumn("more", more).where("more").select("class_name", "prior", "width")
    table = small_rows(found)
    if table is None:
        raise ValueError("too many classes of different sizes")
    rows = [F.struct(F.lit(r["class_name"]).alias("class_name"), F.lit(r["prior"]).alias("prior"), F.lit(r["width"]).alias("width"))
            for r in table.to_pylist()]
    return F.array(*rows).cast("array<struct<class_name:string,prior:double,width:double>>")


def _ranked(score: Column, name: Column) -> Column:
    """Best scores come first, equal ones (to six digits) by name."""
    return F.struct((-F.round(score, 6)).alias("less"), name.alias("class_name"))


def classify_bayes(model: BayesModel, df: DataFrame, text: str, keys, keep=()) -> DataFrame:
    """Predictions in the form of model responses, so that every metric applies to them; ``keys`` are unique.

    Words that no training row has are left out. A text without known words gets the class of most rows.
    """
    keys = as_list(keys)
    counted = df.select(*[F.col(f"`{k}`") for k in keys], _words(text)).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    counted = checkpointed(counted)
    known = settle(model.words.select("word").distinct())
    lengths = counted.join(known.side(), "word").groupBy(*keys).agg(F.sum("n").alias("_known"))
    sums = counted.join(model.words, "word").groupBy(*keys, "class_name").agg(F.sum(F.col("n") * F.col("weight")).alias("shared"))
    classes = settle(model.classes)
    score = F.col("prior") + F.col("shared") - F.col("_known") * F.col("width")
    met = sums.join(classes.side(), "class_name").join(lengths, keys)
    best = met.groupBy(*keys).agg(F.min(_ranked(score, F.col("class_name"))).alias("_best"), F.first("_known").alias("_known"))
    rows = df.join(best, keys, "left")
    length = F.coalesce("_known", F.lit(0))
    others = F.transform(_front(model.classes), lambda c: _ranked(c["prior"] - length * c["width"], c["class_name"]))
    name = F.array_min(F.array_compact(F.concat(others, F.array("_best"))))["class_name"]
    zero = F.lit(0).cast("int")
    response = F.struct(
        name.alias("text"), zero.alias("prompt_tokens"), zero.alias("completion_tokens"), zero.alias("total_tokens"),
        F.lit(0.0).alias("latency"), F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("string").alias("error"),
    )
    return rows.select(*as_list(keep), F.col(f"`{text}`").alias("text"), response.alias("response"))
