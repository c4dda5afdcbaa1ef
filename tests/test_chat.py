from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from labelspark.functions import messages as M
from labelspark.operators import chat as C


def test_combine_columns(articles):
    combined = C.combine_columns(articles, ["title", "content"])
    assert combined.columns == ["id", "label", "split", "text"]
    for r, (t, c) in zip(combined.orderBy("id").take(5), [(r.title, r.content) for r in articles.orderBy("id").take(5)]):
        assert r.text == json.dumps({"title": t, "content": c})
    assert C.combine_columns(articles, ["title"], delete=False).columns == [*articles.columns, "text"]
    onto_input = C.combine_columns(articles, ["title", "content"], new="title")
    assert json.loads(onto_input.first().title).keys() == {"title", "content"}
    with pytest.raises(ValueError, match="no such column: x"):
        C.combine_columns(articles, ["x"])


def test_preprocess_encoded(articles, article_classes):
    chat, vocab = C.preprocess_chat(articles, "content", "label", encoded=article_classes, keep="id")
    assert chat.columns == ["id", "messages"]
    assert chat.dtypes[1][1] == M.MESSAGES_TYPE
    source = {r.id: (r.content, f"Class{r.label:02d}") for r in articles.collect()}
    for r in chat.collect():
        assert [(m.role, m.content) for m in r.messages] == list(zip(("user", "assistant"), source[r.id]))
    assert sorted(r.class_name for r in vocab.collect()) == [f" Class{i:02d}" for i in range(14)]


def test_preprocess_plain_and_several(injuries):
    labels = ["NatureTitle", "Part of Body Title"]
    rows = injuries.dropna()
    chat, vocab = C.preprocess_chat(rows, ["Final Narrative", "Inspection"], labels)
    assert chat.columns == ["messages"]
    content = chat.first().messages
    assert set(json.loads(content[0].content)) == {"Final Narrative", "Inspection"}
    assert list(json.loads(content[1].content)) == labels
    names = {r.class_name for r in vocab.where("label_name = 'NatureTitle'").collect()}
    assert names == {r.NatureTitle.strip() for r in rows.collect()}
    with pytest.raises(ValueError):
        C.preprocess_chat(rows, "nothing", labels)


def test_text_and_label_may_be_one_column(articles):
    chat, _ = C.preprocess_chat(articles.withColumn("label", F.col("title")), "title", "label", keep=["title", "split"])
    assert chat.columns == ["split", "messages"]


def test_endpoints_and_rendering(spark):
    rows = spark.sql("""select array(named_struct('role', 'system', 'content', 's'), named_struct('role', 'user', 'content', ' q\\n'),
                                     named_struct('role', 'assistant', 'content', 'a')) as m""")
    m = F.col("m")
    r = rows.select(M.first_text(m).alias("a"), M.last_text(m).alias("b"), M.render_chatml(m).alias("c"),
                    M.render_zephyr(m, True).alias("d"), M.first_text(F.slice(m, 2, 1)).alias("e")).first()
    assert (r.a, r.b, r.e) == ("s", "a", "q")
    assert r.c == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n q\n<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert r.d == "<|system|>\ns</s>\n<|user|>\n q\n</s>\n<|assistant|>\na</s>\n<|assistant|>\n"


def test_conversations_are_whole(spark):
    turns = spark.range(2500).select(
        F.expr("if(id < 2400, 0, id)").alias("c"), F.col("id").alias("t"), F.lit("user").alias("r"),
        F.col("id").cast("string").alias("x")).repartition(7)
    whole = C.conversation_messages(turns, "c", "t", "r", "x").where("c = 0").first()
    assert [m.content for m in whole.messages] == [str(i) for i in range(2400)]
    ends = {r.c: (r.first_text, r.last_text) for r in C.conversation_ends(turns, "c", "t", "x").collect()}
    assert len(ends) == 101 and ends[0] == ("0", "2399") and ends[2450] == ("2450", "2450")
    lines = C.rendered_turns(turns, "c", "t", "r", "x", M.chatml_turn).where("c = 0").orderBy("turn").collect()
    rendered = turns.sparkSession.createDataFrame([whole]).select(M.render_chatml(F.col("messages")).alias("text")).first().text
    assert "".join(r.line for r in lines) == rendered


def test_doubles_and_nested_values(spark):
    doubles = [12345678.0, 1e16, 1.5e-5, 0.0001, 0.1, 123456789012345.6, -2.5, 0.0, 1e22, 1e-7, 3.0]
    rows = [(x, ["é", "b\"", None], (1, "x"), {"k": 2.0}) for x in doubles]
    df = spark.createDataFrame(rows, "x double, a array<string>, s struct<i:int,t:string>, m map<string,double>")
    for r in C.combine_columns(df, ["x", "a", "s", "m"], delete=False).collect():
        assert r.text == json.dumps({"x": r.x, "a": r.a, "s": {"i": 1, "t": "x"}, "m": {"k": 2.0}})
