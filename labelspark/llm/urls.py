"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

A list has rules ``(host, path, verdict)``. A rule fits its host and all subdomains where the path of
a URL starts with the rule's; the longest rule wins. Every URL is turned into the few keys (host
suffix and path prefix) that a rule of the list could have, by the lengths that occur in the list.
Distinct keys and rules meet in shards by digest. A task writes its shard's digests, sorted, and the
rules' full strings to files of its own, maps them into memory, finds all keys by one vectorised
binary search, confirms each find against the full string, and removes the files.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; of
repeated rules one counts, of contradicting ones ``block``; URLs that no rule fits get ``default``;
empty tables give empty tables, and an empty list the default for all; columns of the table keep
their names, the four results are put beside the id only.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.session import checkpointed

SEED = 42
# Keys and rules that a shard holds on average, at most.
SHARD_ROWS = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL or one without ``://``."""
    mark = F.locate("://", url)
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(key: str) -> int:
    """XXH64 as Spark's ``xxhash64`` gives it."""
    return int(np.uint64(xxhash.xxh64_intdigest(key.encode(), SEED)).view(np.int64))


def probe(keys: pa.Table, rules: pa.Table) -> pa.Table:
    """The rules, ``(key, rule, verdict)``, whose full strings are among ``keys (digest, key)``."""
    found: list[tuple[int, int]] = []
    if keys.num_rows and rules.num_rows:
        rules = rules.sort_by([("digest", "ascending"), ("key", "ascending")])
        strings = [k.encode() for k in rules["key"].to_pylist()]
        with tempfile.TemporaryDirectory() as folder:
            for name, array in (
                ("digests", rules["digest"].to_numpy().astype(np.int64)),
                ("ends", np.cumsum([0, *map(len, strings)], dtype=np.int64)),
                ("strings", np.frombuffer(b"".join(strings) or b"\0", np.uint8)),
            ):
                array.tofile(os.path.join(folder, name))
            del strings
            sorted_ = np.memmap(os.path.join(folder, "digests"), np.int64, "r")
            ends = np.memmap(os.path.join(folder, "ends"), np.int64, "r")
            text = np.memmap(os.path.join(folder, "strings"), np.uint8, "r")
            wanted = keys["digest"].to_numpy()
            first = np.searchsorted(sorted_, wanted, "left")
            last = np.searchsorted(sorted_, wanted, "right")
            hits = np.flatnonzero(last > first)
            for at, key in zip(hits.tolist(), keys["key"].take(pa.array(hits)).to_pylist(), strict=True):
                whole = key.encode()
                for rule in range(first[at], last[at]):
                    if text[ends[rule]:ends[rule + 1]].tobytes() == whole:
                        found.append((at, rule))
            del sorted_, ends, text
    places = pa.array([p for p, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())
    return pa.table({"key": keys["key"].take(places[0]), "verdict": rules["verdict"].take(places[1]),
                     "host_length": rules["host_length"].take(places[1])})


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row; ``rules`` has ``(host, path, verdict)``."""
    key = F.concat(F.translate("host", _UPPER, _UPPER.lower()), "path")
    listed = checkpointed(
        rules.where("host <> '' and path is not null and verdict is not null")
        .groupBy(key.alias("key"), F.char_length("host").alias("host_length")).agg(F.max("verdict").alias("verdict"))
        .withColumn("digest", F.xxhash64("key"))
    )
    # Lengths of hosts and paths in the list: one row each, as many as the longest name has characters.
    shape = listed.select("host_length", (F.char_length("key") - F.col("host_length")).alias("path_length")).agg(
        F.array_sort(F.collect_set("host_length")).alias("hosts"), F.array_sort(F.collect_set("path_length")).alias("paths"),
        F.count("*").alias("rules"),
    ).first()
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    lengths = lambda found: F.array(*map(F.lit, found)).cast("array<int>")
    at = F.char_length("host")
    suffixes = F.filter(lengths(shape.hosts), lambda n: (n == at) | ((n < at) & (F.substring("host", at - n, F.lit(1)) == ".")))
    prefixes = F.filter(lengths(shape.paths), lambda n: n <= F.char_length("path"))
    candidates = F.flatten(F.transform(suffixes, lambda h: F.transform(
        prefixes, lambda p: F.concat(F.right(F.col("host"), h), F.left(F.col("path"), p)))))
    urls = rows.select("host", "path").distinct().select("host", "path", F.explode(candidates).alias("key"))
    shards = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(4 * pages.count() + shape.rules) // shard_rows))
    shard = F.pmod(F.col("digest"), F.lit(shards)).alias("shard")
    keys = urls.select("key").distinct().withColumn("digest", F.xxhash64("key")).select(shard, "digest", "key")
    parts = listed.select(shard, "digest", "key", "verdict", "host_length")

    def meet(left, right):
        return probe(left, right)

    found = keys.groupBy("shard").cogroup(parts.groupBy("shard")).applyInArrow(meet, "key string, verdict string, host_length int")
    length = F.struct(F.char_length("key"), F.col("host_length"))
    best = (
        urls.join(checkpointed(found), "key").groupBy(F.col("host").alias("_host"), F.col("path").alias("_path"))
        .agg(F.max_by("key", F.struct(length, "verdict")).alias("rule"), F.max_by("verdict", F.struct(length, "verdict")).alias("verdict"))
    )
    joined = rows.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return joined.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")).withColumnRenamed("id", id_col)
