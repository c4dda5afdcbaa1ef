"""The corpus pipeline: quality rules, near-copies, personal data, mixing and token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``. A stage
handles nulls, repeated rows, empty tables and further columns as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.llm.bpe import encode
from labelspark.llm.mixing import mix_plan, mixed
from labelspark.llm.pii import sanitise
from labelspark.llm.quality import filter_quality, train_quality
from labelspark.llm.queries import word_vocabulary
from labelspark.llm.simhash import drop_near_copies
from labelspark.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep; trained on those of ``docs`` that have labels."""
    return filter_quality(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a similarity of 0.8 or more."""
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; ``n_chars`` follows the text."""
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs, mix_plan(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every document of the mix."""
    return encode(docs, word_vocabulary(), decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_copies),
    ("pii", personal_data),
    ("mixing sources", mixture),
    ("bpe", token_ids),
]

# Trees, fingerprints and merges are beyond SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
