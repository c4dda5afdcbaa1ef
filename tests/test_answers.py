from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from labelspark.functions import answers as A

NAMES = ["Company", "Educational Institution", "Mean Of Transportation", "Plant", "Nature (wild)", "Unknown"]
CASES = [
    ("Company", 0),
    ("company", 0),
    ("  COMPANY\n", 0),
    ("Comp", 0),
    ("meanof", 2),
    ("Mean of T", 2),
    ("0", 0),
    ("3", 3),
    (" 2 ", 2),
    ("007", 5),
    ("4", 5),  # the strict bound rejects the last real class
    ("5", 5),
    ("99999999999999999999", 5),
    ("-1", 5),
    ("It is a plant, no: a company.", 0),
    ("company? rather a PLANT", 3),
    ("educationalinstitution it is", 1),
    ("Educational   Institution it is", 1),
    ("the nature (wild) of it", 4),
    ("nature wild", 5),
    ("none of these", 5),
    ("my answer is unknown", 5),
    ("", 5),
    (None, 5),
    ("   \t", 5),
    ("Companyx", 0),  # a mention, though not a prefix
    ("sup\x00plant", 3),
]


def parse(spark, expression, answers):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    return [r[0] for r in rows.select(expression(F.col("a")).alias("x"), "i").orderBy("i").collect()]


def test_cases(spark):
    got = parse(spark, lambda c: A.parse_answer(c, NAMES), [a for a, _ in CASES])
    assert list(zip([a for a, _ in CASES], got)) == CASES


def parse_joined(spark, answers, names=NAMES, **options):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").repartition(3)
    return [r.ids.x for r in A.with_class_ids(rows, "a", {"x": names}, "ids", **options).orderBy("i").collect()]


def test_joined_classes_agree(spark, monkeypatch):
    monkeypatch.setattr(A, "EXPRESSION_CLASSES", 0)
    answers = [a for a, _ in CASES]
    assert list(zip(answers, parse_joined(spark, answers))) == CASES
    assert parse_joined(spark, ["4", "5"], strict_numeric=False) == [4, 5]
    assert parse_joined(spark, [" ", ""], blank_is_first=True) == [0, 5]
    assert parse_joined(spark, ["heat", "Heat", "heats", "heatb"], ["Heat burn", "Heat stroke", "Heat", "Unknown"]) == [0, 2, 1, 0]


def test_numbers_mean_the_same_for_any_vocabulary(spark):
    answers = ["0000000007", "00000000000000000007", "2147483648", "1" * 5_000, "1498", "1499"]
    small = [f"class {i:04d}" for i in range(50)] + ["Unknown"]
    large = [f"class {i:04d}" for i in range(1_500)] + ["Unknown"]
    assert parse_joined(spark, answers[:4], small) == [7, 7, 50, 50]
    assert parse_joined(spark, answers, large) == [7, 7, 1500, 1500, 1498, 1500]


def test_paths_agree_on_random_answers(spark, monkeypatch):
    rng = random.Random(5)
    pieces = [*NAMES, "no", "the", "3", " ", "plan", "mean", "of", "(", "É", "\n", "companyplant", "mean  of transportation"]
    answers = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 5))) for _ in range(500)]
    first = parse(spark, lambda c: A.parse_answer(c, NAMES), answers)
    monkeypatch.setattr(A, "EXPRESSION_CLASSES", 0)
    assert parse_joined(spark, answers) == first


def test_options(spark):
    assert parse(spark, lambda c: A.parse_answer(c, NAMES, strict_numeric=False), ["4", "5"]) == [4, 5]
    assert parse(spark, lambda c: A.parse_answer(c, NAMES, blank_is_first=True), [" ", ""]) == [0, 5]


def test_first_of_ambiguous_prefixes(spark):
    names = ["Heat burn", "Heat stroke", "Heat", "Unknown"]
    assert parse(spark, lambda c: A.parse_answer(c, names), ["heat", "Heat", "heats", "heatb"]) == [0, 2, 1, 0]


def test_unknown_is_appended_to_a_copy():
    vocab = {"a": ["x"], "b": ["y", "z"]}
    assert A.with_unknown(vocab) == {"a": ["x", "Unknown"], "b": ["y", "z", "Unknown"]}
    assert A.with_unknown(vocab) == {"a": ["x", "Unknown"], "b": ["y", "z", "Unknown"]}
    assert vocab == {"a": ["x"], "b": ["y", "z"]}


VOCAB = {"nature": ["Burn", "Cut", "None", "Unknown"], "part of body": ["Arm", "Leg", "Unknown"]}
MULTI = [
    ('{"nature": "Cut", "part of body": "Leg"}', (1, 1)),
    ('I think\n{"nature": "burn",\n "part of body": "the arm"} {"nature": "Cut"}', (0, 0)),
    ('{"part of body": "Leg", "nature": "Cut"}', (1, 1)),
    ('{"kind": "Cut", "where": "Leg"}', (1, 1)),  # both misnamed, found by position
    ('{"nature": "Cut", "where": "Leg"}', (1, 1)),
    ('{"where": "Leg", "nature": "Cut"}', (1, 2)),  # the second field stands for the second label
    ('{"nature": "Cut"}', (1, 2)),
    ('{"nature": "Cut", "x": 1, "y": 2}', (1, 2)),
    ('{"nature": null, "part of body": 1}', (2, 2)),
    ('{"nature": ["Cut"], "part of body": 0}', (1, 0)),
    ('{"nature": "x", "nature": "Burn", "part of body": "Arm"}', (0, 0)),
    ("{'nature': 'Cut', 'part of body': 'Leg'}", (3, 2)),
    ('{"nature": {"a": "Cut"}, "part of body": "Leg"}', (3, 2)),
    ('{"nature": "Cut", "part of body": "Leg",}', (3, 2)),
    ('{"nature": "", "part of body": " "}', (3, 2)),
    ("{}", (3, 2)),
    ("5", (3, 2)),
    ('["Cut", "Leg"]', (3, 2)),
    ("Cut and Leg", (3, 2)),
    ("", (3, 2)),
    (None, (3, 2)),
]


@pytest.mark.parametrize("limit", [1_000, 0, 3])
def test_json_answers(spark, monkeypatch, limit):
    monkeypatch.setattr(A, "EXPRESSION_CLASSES", limit)
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(MULTI)], "i int, answer string")
    ids = A.with_class_ids(rows, "answer", VOCAB, "ids").orderBy("i").collect()
    got = [(a, (r.ids["nature"], r.ids["part of body"])) for (a, _), r in zip(MULTI, ids)]
    assert got == MULTI


@pytest.mark.parametrize("limit", [1_000, 0])
def test_empty_fields_as_first_class(spark, monkeypatch, limit):
    monkeypatch.setattr(A, "EXPRESSION_CLASSES", limit)
    answers = ['{"nature": "", "part of body": " "}', "", '{"nature": ""}']
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, answer string")
    ids = A.with_class_ids(rows, "answer", VOCAB, "ids", blank_is_first=True).orderBy("i").collect()
    assert [tuple(r.ids) for r in ids] == [(0, 0), (3, 2), (0, 2)]


def test_parsing_works_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(a,) for a, _ in CASES], "answer string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("answer string").parquet(str(tmp_path / "in"))
    parsed = A.with_class_ids(stream, "answer", {"label": NAMES}, "ids")
    query = (
        parsed.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.answer, r.ids["label"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == set(CASES)


def vocabulary(spark, names, label="x"):
    return spark.createDataFrame([(label, i, n) for i, n in enumerate(names)], "label_name string, class_id int, class_name string")


def test_a_table_of_names_agrees(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, a string").repartition(3)
    found = A.with_class_ids(rows, "a", vocabulary(spark, NAMES), "ids", labels="x").orderBy("i").collect()
    assert [(r.a, r.ids.x) for r in found] == CASES
    tables = [vocabulary(spark, names, label) for label, names in VOCAB.items()]
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(MULTI)], "i int, answer string")
    ids = A.with_class_ids(rows, "answer", tables[0].union(tables[1]), "ids", labels=list(VOCAB)).orderBy("i").collect()
    assert [(a, (r.ids["nature"], r.ids["part of body"])) for (a, _), r in zip(MULTI, ids)] == MULTI
    with pytest.raises(ValueError, match="no classes of y"):
        A.with_class_ids(rows, "answer", tables[0], "ids", labels="y")


def test_many_names_stay_a_table(spark):
    n = 150_000
    vocab = spark.range(n).select(
        F.lit("x").alias("label_name"), F.col("id").cast("int").alias("class_id"), F.format_string("Name %06d of all", "id").alias("class_name"))
    vocab = vocab.union(spark.createDataFrame([("x", n, "Unknown")]))
    answers = [("Name 149999 of all", n - 1), ("so it is name 000123 ofall, I think", 123), ("name000007", 7), ("name 00", 0), ("149000", 149_000),
               ("149999", n), ("name 150000 of all", n), ("name 1 of all", n), (None, n)]
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(answers)], "i int, a string")
    found = A.with_class_ids(rows, "a", vocab, "ids", labels="x").orderBy("i").collect()
    assert [(r.a, r.ids.x) for r in found] == answers


def test_last_mentions_equal_a_scan(spark):
    draw = random.Random(8)
    words = ["ab", "abc", "b", "cab", "É", "(x)", "😀", "a.b", "ccccccccc", "ccccccccccccc"]
    names = sorted({" ".join(draw.choice(words) for _ in range(draw.randint(1, 3))) for _ in range(60)}) + ["Unknown"]
    pattern = re.compile(A.mention_pattern(names).lower())
    plain = [n.lower().replace(" ", "") for n in names]
    texts = ["".join(draw.choice([*words, " ", "  ", "z", "\n"]) for _ in range(draw.randint(1, 30))) for _ in range(400)]
    rows = spark.createDataFrame([*enumerate(texts), (400, ""), (401, None), (402, texts[0])], "i int, t string")
    found = {r.i: r.c for r in A.last_mentions(rows, "t", vocabulary(spark, names), "x", "c").collect()}
    for i, text in enumerate([*texts, "", "", texts[0]]):
        hits = pattern.findall(text.lower().strip())
        assert found[i] == (plain.index(hits[-1].replace(" ", "")) if hits else None), text


def test_long_texts_cost_their_length(spark):
    vocab = vocabulary(spark, [f"class number {i}" for i in range(1_002)])
    seconds = {}
    for size in (2_000, 20_000, 80_000):
        text = ("class of things, class number seven or class number 7 it was " * (size // 60))[:size]
        started = time.perf_counter()
        (row,) = A.last_mentions(spark.createDataFrame([(text,)], "t string"), "t", vocab, "x", "c").collect()
        seconds[size] = time.perf_counter() - started
        assert row.c == 7
    # Four times the text; a cost that grows with the square would be sixteen times as high.
    assert seconds[80_000] < 6 * seconds[20_000]


def test_no_names_and_no_texts(spark):
    rows = spark.createDataFrame([("a",)], "t string")
    assert A.last_mentions(rows, "t", vocabulary(spark, ["x"]).limit(0), "x", "c").collect()[0].c is None
    assert A.last_mentions(rows.limit(0), "t", vocabulary(spark, ["x"]), "x", "c").count() == 0
