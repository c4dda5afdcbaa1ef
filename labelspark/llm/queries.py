"""One query for each operator of this folder, on the driver's tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.llm.bpe import decode, encode
from labelspark.llm.html import extract, train_extractor
from labelspark.llm.mixing import mix_counts, mix_plan
from labelspark.llm.ngrams import fold_held_out, score_texts
from labelspark.llm.periods import find_runs, plant_periods, strongest
from labelspark.llm.pii import PATTERNS, private_spans, span_text
from labelspark.llm.quality import score_quality, train_quality
from labelspark.llm.simhash import near_groups
from labelspark.llm.suffix import remove_repeats
from labelspark.llm.urls import filter_urls
from labelspark.llm.variants import spelling_forms, vocabulary
from labelspark.llm.vptree import search
from labelspark.llm.warc import read_archives, write_archives
from labelspark.session import scratch_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Fixed values of the contract: host, path and verdict of every rule.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def word_vocabulary() -> str:
    """The public vocabulary with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(_table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = private_spans(_table(spark, folder, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    every = F.concat("base", F.transform("terms", lambda t: t["span"]))
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(every).alias("spans"),
    )


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return extract(pages, train_extractor(pages))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_counts(mix_plan(_table(spark, folder, "documents"))).withColumnRenamed("id", "doc_id")


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(_table(spark, folder, "pages"), rules)


def op7_vptree(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(_table(spark, folder, "pages"), path)
    return read_archives(spark, path, payloads=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = word_vocabulary()
    return decode(encode(_table(spark, folder, "documents"), path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    trees = train_quality(docs, _table(spark, folder, "labels"))
    return score_quality(docs, trees).drop("probability")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_forms(vocabulary(_table(spark, folder, "documents")))


def op12_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(_table(spark, folder, "documents"), fold_held_out())


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = find_runs(plant_periods(_table(spark, folder, "documents"))).withColumn("best", strongest())
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_pii, op3_suffix_dedup, op4_html, op5_mixing, op6_url_filter, op7_vptree, op8_warc, op9_bpe, op10_quality_rules, op11_spelling_variants, op12_lm_scoring, op13_periodic_runs)}


def all_sql() -> dict[str, str]:
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    return {
        "op6_url_filter": f"""
            WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
            rest AS (
                SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
                FROM pages
            ),
            parts AS (
                SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
                FROM rest
            ),
            fits AS (
                SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.rule_verdict,
                       row_number() OVER (PARTITION BY p.page_id
                                          ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS place
                FROM parts p LEFT JOIN rules r
                  ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
            )
            SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE place = 1
        """,
        "op7_vptree": """
            WITH usable AS (
                SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            ),
            scored AS (
                SELECT q.vec_id AS query_id, c.vec_id,
                       sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])),
                                        lambda a, b: a + b)) AS score
                FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
                WHERE q.vec_id % 100 = 0
            ),
            ranked AS (
                SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM scored
            )
            SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
        """,
        "op8_warc": """
            WITH rows AS (
                SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
                FROM pages
            ),
            resolved AS (
                SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original
                FROM rows
            )
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
            FROM resolved
        """,
    }
