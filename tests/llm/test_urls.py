from __future__ import annotations

import random

import pyarrow as pa

from labelspark.llm import urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("EXAMPLE.com", "", "block"), ("a.example.com", "/é", "allow")]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v, h.lower() + p) for h, p, v in rules
            if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    return host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else "allow"


def test_against_brute_force(spark):
    draw = random.Random(7)
    hosts = ["example.org", "x.example.org", "EXAMPLE.ORG", "notexample.org", "org", "a.b.com", "example.com", "a.example.com", "com", "net", "", "org.", ".org"]
    paths = ["", "/", "/es/x", "/es", "/en/1", "/en/19", "/fr/", "/de/é", "/é", "/en/1/#top", "?q=/es/", "#/es/", "/a?b://c"]
    found = [f"{draw.choice(['http', 'HTTPS', ''])}://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(600)]
    found += [None, "", "no mark", "a://", "://", "x://y://z", "mailto:a@example.org", "http://example.org\n/es/", "http://" + "a." * 3_000 + "org/" + "x" * 9_000]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(found)], "page_id bigint, url string, rule string, verdict string")
    rules = spark.createDataFrame(RULES * 2, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages.repartition(3), rules, shard_rows=50).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(found)}


def test_collisions_are_confirmed():
    rules = pa.table({"digest": [5, 5, 7], "key": ["a/", "b/", "c/"], "verdict": ["block", "allow", "block"], "host_length": pa.array([1, 1, 1], pa.int32())})
    keys = pa.table({"digest": [5, 5, 7, 9], "key": ["b/", "z/", "other/", "c/"]})
    assert urls.probe(keys, rules).to_pylist() == [{"key": "b/", "verdict": "allow", "host_length": 1}]


def test_digest_is_the_engines(spark):
    for key in ("", "org/", "é" * 50):
        assert spark.sql(f"select xxhash64('{key}')").first()[0] == urls.digest(key)


def test_contradictions_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id bigint, url string")
    rules = spark.createDataFrame([("b", "/", "allow"), ("b", "/", "block"), (None, "/", "block"), ("b", None, "block")], "host string, path string, verdict string")
    assert sorted((str(r.page_id), r.rule, r.verdict) for r in urls.filter_urls(pages, rules).collect()) == [
        ("1", "b/", "block"), ("1", "b/", "block"), ("None", None, "allow")]
    assert {r.verdict for r in urls.filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert urls.filter_urls(pages.limit(0), rules).count() == 0
