from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from labelspark.functions.json_text import json_object
from labelspark.functions.text import escape_prompt, normalise_label, slug, slug_text, strip, truncate_label

TEXTS = [
    "", " ", "plain", "\t　 both ends \n", "in ner\tspace", "\x1cfile\x1f", "é\u0001\"\\/\b\f\r\n\x7f", "😀 emoji",
    "ÀÉ Mixed-Case_9!", "日本 語",
]


def column(spark, expression, texts=TEXTS):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    return [r[0] for r in rows.select(expression(F.col("s")).alias("x"), "i").orderBy("i").collect()]


def test_strip_is_unicode_strip(spark):
    assert column(spark, strip) == [t.strip() for t in TEXTS]


def test_normalise_label(spark):
    assert column(spark, normalise_label) == [t.lower().strip().replace(" ", "") for t in TEXTS]


def test_slug(spark):
    expected = ["".join(c for c in t.lower().strip().replace(" ", "_") if c.isalnum() or c in "-_") for t in TEXTS]
    assert column(spark, slug) == expected
    assert [slug_text(t) for t in TEXTS] == expected


def test_truncate_label(spark):
    assert column(spark, lambda c: truncate_label(c, 5), ["12345", "123456", ""]) == ["12345", "12345...", ""]


def test_escape_prompt(spark):
    assert column(spark, escape_prompt, ['a\n"b"']) == ['a\\n\\"b\\"']


@pytest.mark.parametrize("compact", [False, True])
def test_json_object(spark, compact):
    rows = [(i, t if i % 3 else None, i * 7, i % 2 == 0) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "`the id` int, s string, n long, flag boolean")
    columns = ["s", "n", "flag", "the id"]
    got = [r[0] for r in df.select(json_object(df.schema, columns, compact)).collect()]
    for text, (i, s, n, flag) in zip(got, rows):
        want = {"s": s, "n": n, "flag": flag, "the id": i}
        assert json.loads(text) == want
        if not compact:
            assert text == json.dumps(want)
