"""Small documents with the cases that every operator must stand."""

from __future__ import annotations

import random

import pytest

LONG = "a long text of plain words that goes on " * 3_000


def odd_texts() -> list[str | None]:
    """Null, empty, blank, very long, repeated and non-Latin texts."""
    draw = random.Random(1)
    words = ["alpha", "beta", "Gamma", "déjà", "vu", "中文", "delta.", "x", "😀", "the", "of", "and"]
    some = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 120))) for _ in range(20)]
    return [None, "", " \t\n", LONG, "one", "two words", *some, some[0], some[0], some[1] + " more", "same\nsame\nother\n"]


DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use themselves.
CLASH = "id string, fp string, h string, size string, pattern string, node string, base string, ids string, spans string, kept string, digest string, runs string, url string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, repeated rows and columns with clashing names."""
    rows = []
    for i, text in enumerate(odd_texts()):
        rows.append((i, text, "en", f"s{i % 3}", 1))
    rows += [(40, "a text without a source", None, None, None), (None, "a text without an id", "en", "s0", 3), (5, "two words", "en", "s2", 1)]
    extra = tuple("?" for _ in CLASH.split(","))
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{DOCUMENT}, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    """No documents."""
    return spark.createDataFrame([], f"{DOCUMENT}, {CLASH}")
