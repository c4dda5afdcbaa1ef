from __future__ import annotations

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspark.llm import suffix


def test_suffix_order():
    draw = random.Random(11)
    for trial in range(80):
        strings = [bytes(draw.choice(b"ab" if trial % 2 else b"abc\xc3") for _ in range(draw.randint(1, 12))) for _ in range(draw.randint(1, 8))]
        with tempfile.TemporaryDirectory() as folder:
            symbols, prefixes = suffix.suffix_order(strings, folder)
        every = sorted(((k, i) for k, s in enumerate(strings) for i in range(len(s) + 1)), key=lambda x: (strings[x[0]][x[1]:], x[0]))
        number = {c: n + 1 for n, c in enumerate(sorted(set(b"".join(strings))))}
        assert symbols.tolist() == [number[strings[k][i - 1]] if i else 0 for k, i in every]

        def common(a, b):
            x, y = (strings[k][i:] for k, i in (a, b))
            return next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

        assert prefixes.tolist() == [0, *[common(a, b) for a, b in zip(every, every[1:])]]


def test_equal_windows_have_equal_anchors():
    draw = random.Random(12)
    part = bytes(draw.randrange(97, 101) for _ in range(400))
    for text in (part + b"xyz" * 9 + part, b"a" * 500, b"ab" * 300):
        place = suffix.anchors(suffix.substring_hashes(np.frombuffer(text + bytes(8), np.uint8)))
        seen: dict[bytes, int] = {}
        for at in range(len(text) - suffix.LENGTH + 1):
            offset = int(place[at]) - at
            assert 0 <= offset <= suffix.LENGTH - suffix.ANCHOR
            assert seen.setdefault(text[at:at + suffix.LENGTH], offset) == offset


def brute(docs):
    """Rows in order of id (null last); equal (id, text) once."""
    seen: set[bytes] = set()
    found = {}
    for id_, text in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            window = data[at:at + 100]
            if window in seen:
                gone[at:at + 100] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
        found[id_] = (len(data), [tuple(e) for e in edges.tolist()], bytes(np.frombuffer(data, np.uint8)[~gone]))
    return found


def documents():
    draw = random.Random(13)
    parts = ["".join(draw.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    docs = []
    for i in range(60):
        text = ""
        for _ in range(draw.randint(0, 6)):
            first = draw.randint(0, 300)
            text += draw.choice(parts)[first:first + draw.randint(50, 300)]
            if draw.random() < 0.3:
                text += "".join(draw.choice("xyz ") for _ in range(draw.randint(0, 150)))
            if draw.random() < 0.1:
                text += draw.choice(["a" * draw.randint(90, 300), "abcé" * draw.randint(30, 60)])
        docs.append((i, text))
    docs += [(100 + k, docs[3][1]) for k in range(4)] + [(7, docs[7][1])] * 2
    return docs + [(200, ""), (201, "x" * 99), (202, "x" * 100), (203, "x" * 101), (204, None), (None, docs[5][1] + "tail"), (205, "long words " * 30_000)]


@pytest.mark.parametrize(("hot", "collection", "chunk"), [(2_000, 16_384, 4 << 20), (2, 50, 2_000)])
def test_against_brute_force(spark, monkeypatch, hot, collection, chunk):
    monkeypatch.setattr(suffix, "COLLECTION", collection)
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix, "PIECE_BYTES", max(chunk, 1_000))
    docs = documents()
    df = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], "doc_id bigint, text string, h string, runs string, kept string").repartition(7)
    rows = suffix.remove_repeats(df, hot=hot).collect()
    want = brute(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) == want[r.doc_id], r.doc_id


def test_empty_table(spark, odd):
    assert suffix.remove_repeats(odd.limit(0)).count() == 0
    assert suffix.remove_repeats(odd).count() == odd.count()


def test_texts_whose_short_hashes_collide_stay_apart(spark):
    texts = spark.range(300_000).select(F.concat(*[F.md5(F.concat(F.lit(str(k)), "id")) for k in range(6)]).alias("text"))
    twin = texts.groupBy(F.hash("text").alias("h")).agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").first()
    df = spark.createDataFrame([(1, twin.a), (None, twin.a), (None, twin.b), (7, twin.b[:150]), (7, twin.a[:150] + "z")], "doc_id bigint, text string")
    rows = {(r.doc_id, r.n_bytes): bytes(r.kept).decode() for r in suffix.remove_repeats(df).where("doc_id is not null").collect()}
    assert rows == {(1, 192): twin.a, (7, 150): twin.b[:150], (7, 151): "z"}
    # Without an id: the text of document 1 goes; of the other one the first 150 bytes stand in document 7.
    kept = sorted(bytes(r.kept).decode() for r in suffix.remove_repeats(df).where("doc_id is null").collect())
    assert kept == sorted(["", twin.b[150:]])


def test_many_identical_rows_are_one_document(spark, monkeypatch):
    text = "".join(chr(97 + (i * i) % 23) + str(i) for i in range(200))
    copies = spark.range(50_000).select(F.lit(3).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    df = copies.union(spark.createDataFrame([(4, text + "tail")], "doc_id bigint, text string"))
    rows, once = suffix._documents(df.select(F.col("doc_id").alias("given"), "text"))
    assert (rows.count(), once.count()) == (50_001, 2)
    got = suffix.remove_repeats(df).groupBy("doc_id", "kept").count().collect()
    assert {(r.doc_id, bytes(r.kept).decode(), r["count"]) for r in got} == {(3, text, 50_000), (4, "tail", 1)}
