"""The pipeline against its stages done by brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from labelspark.llm import quality
from labelspark.llm.mixing import targets
from labelspark.llm.queries import word_vocabulary


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(14)
    words = ["".join(draw.choice("bcdfghjklm") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(3_000)]
    rows, labels = [], []
    for i in range(160):
        text = [draw.choice(words) for _ in range(draw.randint(80, 200))]
        good = i % 4 != 0
        if not good:
            text = [w + "###" for w in text]
        rows.append([i, " ".join(text), "en", f"src{i % 3}", 0])
        labels.append((i, int(good), 0))
    for i in range(1, 20, 2):  # copies, near-copies and personal data
        near = rows[i][1].split()
        near[3] = "changed"
        rows.append([1_000 + i, " ".join(near), "en", "src0", 0])
        rows.append([2_000 + i, rows[i][1], "en", "src1", 0])
        rows[i + 40][1] += f" u{i}@example.org"
    rows += [[3_000, None, None, None, None], [3_001, "", "en", "src0", 0], [None, rows[41][1] + " tail", "en", None, 0]]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_and_whole(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    found = []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        found.append(docs.collect())
    kept, single, clean, mix, ids = found
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    trees = quality.train_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))

    def good(text):
        base, features = quality.statistics((text or "").encode())
        return not base[5] and trees.probability(quality.np.array([features]))[0] >= 0.5

    assert {r.doc_id for r in kept} == {i for i, t in texts.items() if good(t)}
    assert {r.doc_id for r in kept} >= {i for i in range(160) if i % 4}

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}

    sets = {r.doc_id: shingles(r.text) for r in kept}
    order = sorted(sets, key=lambda i: (i is None, i or 0))
    least = {}
    for i in order:
        least[i] = next((least[j] for j in least if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])), i)
    assert {r.doc_id for r in single} == set(least.values()) and len(single) == len(set(least.values()))
    assert {r.doc_id: r.text for r in clean} == {r.doc_id: re.sub(r"u\d+@example.org", "[EMAIL]", r.text) for r in single}
    assert all(r.n_chars == len(r.text) for r in clean)
    sizes: dict = {}
    for r in clean:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for source, target in zip(order, targets([sizes[s] for s in order])):
        taken = sum(len(r.text.split()) for r in mix if r.source == source)
        assert abs(taken - target) <= max(0.1 * target, 20)
    library = Tokenizer.from_file(word_vocabulary())
    want = []
    for r in mix:
        encoded = library.encode(r.text, add_special_tokens=False).ids
        decoded = library.decode(encoded, skip_special_tokens=False)
        want.append((str(r.doc_id), len(encoded), encoded, hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, list(r.ids), r.decoded_sha256) for r in ids) == sorted(want)
    whole = pipeline.run(spark, folder)
    assert sorted((str(r.doc_id), list(r.ids)) for r in whole.collect()) == sorted((w[0], w[2]) for w in want)


def test_empty_table_and_further_columns(spark, folder, odd, tmp_path):
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        for i, (_, stage) in enumerate(pipeline.STAGES):
            found = stage(spark, docs, folder)
            if i < len(pipeline.STAGES) - 1:
                assert found.columns == docs.columns
            path = f"{tmp_path}/{name}-{i}"
            found.write.parquet(path)
            docs = spark.read.parquet(path)
