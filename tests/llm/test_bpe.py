from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from labelspark.llm import bpe
from labelspark.llm.queries import word_vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_vocabulary())


def test_like_the_library(library):
    draw = random.Random(2)
    alphabet = "aAbBéÉΣσ'stm \t\n\x0b\x1c\x85\xa0́̈İıß123٣½中文ก้😀👍🏽ﬁ​\x00K<|"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(1_500)]
    texts += ["x<|endoftext|>y <|startoftext|>", "<|endoftext|>", "ΑΣ ΣΑΣ", "don't we'll I'm THEY'RE", "a" * 5_000, "aaaa aaa aa"]
    texts += ["".join(chr(draw.randint(0, 0x24F)) for _ in range(30)) for _ in range(500)]
    encoder = bpe.Encoder(word_vocabulary())
    assert encoder.encode([t.encode() for t in texts]).to_pylist() == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_small_batches_and_forgetting(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "INDEXED_WORDS", 2)
    encoder = bpe.Encoder(word_vocabulary())
    for _ in range(2):
        for text in ("the quick brown fox", "jumps over the lazy dog", "internationalisation of the the"):
            assert encoder.encode([text.encode()]).to_pylist()[0] == library.encode(text, add_special_tokens=False).ids


def test_round_trip(odd, none, library):
    path = word_vocabulary()
    rows = bpe.decode(bpe.encode(odd, path), path).collect()
    at_once = bpe.encode(odd, path, decoded=True).collect()
    assert sorted((str(r.doc_id), r.text) for r in at_once) == sorted((str(r.doc_id), r.text) for r in rows)
    texts = odd.select("doc_id", "text").collect()
    want = []
    for r in texts:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    by = lambda x: (str(x[0]), x[2])
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in rows), key=by) == sorted(want, key=by)
    assert bpe.encode(none, path).count() == 0


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [49407, 10**6, -1, 320])], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(rows, word_vocabulary()).collect()}
    assert got == {1: "", 2: "", 3: "<|endoftext|> a</w>"}


def test_words_stay_known_when_chunks_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(word_vocabulary())
    texts = [b"some words, which come again", "déjà vu <|endoftext|> 12".encode()]
    first = encoder.encode(texts).to_pylist()
    indexed = []
    index = encoder.encode_words
    monkeypatch.setattr(encoder, "encode_words", lambda words: indexed.extend(words) or index(words))
    assert encoder.encode(texts).to_pylist() == first and indexed == []
    # Words have a bound of their own.
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 3)
    assert encoder.encode(texts).to_pylist() == first and b"some" in indexed


def test_short_words_are_merged_side_by_side(library, monkeypatch):
    # The rounds that all short words share are few: no more than the bytes of the longest one.
    encoder = bpe.Encoder(word_vocabulary())
    draw = random.Random(5)
    words = ["".join(draw.choice("aaabcdehiklnorstu") for _ in range(draw.randint(1, bpe.SHORT))) for _ in range(3_000)]
    words += ["a" * n for n in range(1, 2 * bpe.SHORT)] + ["\x00", "é" * bpe.SHORT]
    rounds = []
    rank = encoder.rank
    monkeypatch.setattr(encoder, "rank", lambda left, right: rounds.append(len(left)) or rank(left, right))
    got = encoder.encode([w.encode() for w in words]).to_pylist()
    assert got == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert 0 < len(rounds) <= bpe.SHORT
    # The bound divides the work and changes nothing.
    for bound in (0, 10_000):
        monkeypatch.setattr(bpe, "SHORT", bound)
        assert bpe.Encoder(word_vocabulary()).encode([w.encode() for w in words]).to_pylist() == got


def test_blanks_and_slices(library):
    import pyarrow as pa

    texts = ["", " ", "\n a  b\t", None, "a\x0bb\x0cc\rd", "x\x1cy\x85z\xa0w", "last "]
    column = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    got = bpe.Encoder(word_vocabulary()).encode(column).to_pylist()
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
