from __future__ import annotations

import gzip
import hashlib
import io
import random
import re

import pytest

from labelspark.llm import warc
from labelspark.session import scratch_path


def pages():
    draw = random.Random(8)
    payloads = ["", "short", "é" * 600, "x\r\n\r\nWARC/1.1\r\n" * 100, "y" * 999, "z" * 1_000, "w" * 200_000]
    rows = [(i, f"http://a/{i}", draw.choice(payloads)) for i in range(200)]
    return rows + [(300, None, None), (None, "http://none", "z" * 1_000), (301, "http://a/b\r\nX: y", "é" * 600), (302, "u", "q" * 5_000), (302, "u", "q" * 5_000),
                   (303, "u", "q" * 5_000), (303, "u", "other" * 500)]


def brute(rows):
    found = []
    for id_, _, payload in rows:
        body = (payload or "").encode()
        same = [i for i, _, p in rows if i is not None and (p or "").encode() == body] if len(body) >= 1_000 else []
        original = max(same) if same else None
        revisit = original is not None and id_ != original
        found.append((id_, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", original if revisit else None))
    return sorted(found, key=str)


def test_round_trip(spark):
    rows = pages()
    path = scratch_path(spark, "test-archives")
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(4)
    warc.write_archives(df, path)
    read = warc.read_archives(spark, path).collect()
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str) == brute(rows)
    assert sorted(r.payload for r in read) == sorted(p or "" for _, _, p in rows)
    assert {r.id: r.url for r in read}[300] is None
    folder = re.sub("^file:", "", path)
    stored = b"".join(gzip.open(f).read() for f in __import__("pathlib").Path(folder).glob("*.gz"))
    kept = list(warc.records(io.BytesIO(stored)))
    assert len(kept) == len(rows)
    ids = [f["WARC-Record-ID"] for f, _ in kept]
    assert all(f["WARC-Refers-To"] in ids for f, _ in kept if f["WARC-Type"] == "revisit")
    assert stored.count(b"w" * 200_000) <= 1


def test_broken_archives_are_refused():
    with pytest.raises(ValueError, match="begins"):
        list(warc.records(io.BytesIO(b"garbage\r\n")))
    with pytest.raises(ValueError, match="block"):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")))
    with pytest.raises(ValueError, match="fields"):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n")))


def test_empty_table(spark):
    path = scratch_path(spark, "test-empty")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
