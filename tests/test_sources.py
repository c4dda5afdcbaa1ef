from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from labelspark import session
from labelspark.operators import metrics as M
from labelspark.operators import rollup as R
from labelspark.operators.splits import random_split
from labelspark.plans.config import RunConfig
from labelspark.sources import runs, tables


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'quote " and \\ slash', 1.5), (2, " padded \n two lines, comma ", None), (3, "", 0.0), (4, None, 2.0), (5, 'ends with \\', 1.0)]
    df = spark.createDataFrame(rows, "id int, `a text` string, x double")
    path = str(tmp_path / "t.csv")
    tables.write_csv(df, path)
    want = rows
    assert sorted(map(tuple, tables.read_csv(spark, path, df.schema).collect())) == sorted(want)
    assert dict(tables.read_csv(spark, path).dtypes) == {"id": "int", "a text": "string", "x": "double"}


def test_csv_after_preamble(spark, tmp_path):
    for i in range(3):
        lines = ["My sheet", "", 'Result Path,"a, b"', *[f'path {i} {j},"x, ""{j}"""' for j in range(40)]]
        (tmp_path / f"part{i}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    try:
        rows = tables.read_csv_after(spark, str(tmp_path), 2)
        assert rows.columns == ["Result Path", "a, b"]
        assert {tuple(r) for r in rows.collect()} == {(f"path {i} {j}", f'x, "{j}"') for i in range(3) for j in range(40)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tables.read_csv_after(spark, str(tmp_path), 2, "Result Path").columns == ["Result Path"]
    with pytest.raises(ValueError):
        tables.read_csv_after(spark, str(tmp_path), 500)


def test_missing_words_are_null_in_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("text,label,n\na,NA,1\nb,None,2\nnull,x,3\nc,Nature,4\n")
    rows = {tuple(r) for r in tables.read_table(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {("a", None, 1), ("b", None, 2), (None, "x", 3), ("c", "Nature", 4)}


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_load_labelled(spark, injuries, tmp_path, kind):
    path = str(tmp_path / f"data.{kind}")
    if kind == "csv":
        tables.write_csv(injuries, path)
    else:
        getattr(injuries.write, kind)(path)
    chat, vocab = tables.load_labelled(spark, path, "Final Narrative", ["NatureTitle", "Part of Body Title"])
    assert chat.columns == ["messages"]
    assert chat.count() == injuries.dropna().count()
    assert {r.label_name for r in vocab.collect()} == {"NatureTitle", "Part of Body Title"}
    assert all(r.class_name == r.class_name.strip() for r in vocab.collect())


def test_load_options(spark, articles, article_classes):
    named = articles.withColumn("label", F.concat(F.lit(" c"), "label")).drop("split")
    chat, _ = tables.prepare_labelled(named, "content", "label", test_size=0.25, balanced=True, ratio=0.5, keys="id")
    sizes = {r.split: r["count"] for r in chat.groupBy("split").count().collect()}
    assert sizes["test"] <= 210 and sizes["train"] <= 630 and sizes["test"] % 14 == 0
    sampled, _ = tables.prepare_labelled(named, ["title", "content"], "label", size=9, keys="id")
    assert sampled.count() == 9 and json.loads(sampled.first().messages[0].content).keys() == {"title", "content"}
    one, _ = tables.prepare_labelled(articles.withColumn("label", F.col("label").cast("string")), "content", "label", split="test")
    assert one.columns == ["messages"] and one.count() == 280


def test_load_errors(spark, articles):
    with pytest.raises(ValueError, match="expected a .csv"):
        tables.load_labelled(spark, "/no/such/thing", "a", "b")
    with pytest.raises(ValueError):
        tables.prepare_labelled(articles, "content", "label", ratio=2)
    with pytest.raises(ValueError):
        tables.prepare_labelled(articles, "content", "label", ratio=0.5, size=3)
    with pytest.raises(ValueError):
        tables.prepare_labelled(articles.drop("split"), "content", "label", split="train")


def test_write_splits(spark, articles, tmp_path):
    rows = random_split(articles.drop("split"), 0.25, "id")
    tables.write_splits(rows, str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=test").is_dir()
    back = tables.read_csv(spark, str(tmp_path / "s"), rows.schema)
    assert sorted(map(str, back.select(rows.columns).collect())) == sorted(map(str, rows.collect()))


VOCAB = {"Kind of": ["a", "b", "Unknown"]}


@pytest.fixture(scope="module")
def predicted(spark):
    rows = [(i, f"text {i}\né \"q\" \\", "a" if i % 2 else "b", (f"ans, {i}", 2, 1, 3, 0.25, None, None), (i % 3,), (1 - i % 2,)) for i in range(60)]
    response = "struct<text:string,prompt_tokens:int,completion_tokens:int,total_tokens:int,latency:double,reasoning:string,error:string>"
    ids = "struct<`Kind of`:int>"
    return spark.createDataFrame(rows, f"id int, text string, truth string, response {response}, predicted {ids}, actual {ids}")


def test_run_round_trip_and_roll_up(spark, predicted, tmp_path):
    report = M.classification_report(M.confusion_counts(predicted, VOCAB))
    folders = []
    for name in ("Zero-shot", "Few shot"):
        config = RunConfig(name, 16, "prompt", thinking_tokens=1024)
        folders.append(runs.write_run(predicted, VOCAB, config, report, "id", 30.0, str(tmp_path)))
    assert [f.rsplit("/", 1)[1] for f in folders] == ["zero-shot", "few_shot"]
    header = runs.read_headers(spark, f"{folders[1]}/run")
    row = header.first()
    assert (row.config.technique_name, row.config.prompt, row.config.thinking_tokens) == ("Few shot", "prompt", 1024)
    assert row.label_names == VOCAB and row.total_time_elapsed == 30.0
    samples = runs.read_samples(spark, f"{folders[0]}/samples", ["Kind of"], "id int")
    assert sorted(map(str, samples.collect())) == sorted(map(str, predicted.select(samples.columns).collect()))
    wrong = tables.read_csv(spark, f"{folders[0]}/incorrect_answers.csv")
    assert wrong.count() == predicted.where("predicted != actual").count()

    reports = runs.read_reports(spark, f"{tmp_path}/*")
    assert {(r.run_id, r.label_name) for r in reports.collect()} == {("zero-shot", "kind_of"), ("few_shot", "kind_of")}
    known = {(r.row_key, round(r.precision, 9), r.support) for r in report.collect()}
    assert {(r.row_key, round(r.precision, 9), r.support) for r in reports.where("run_id = 'few_shot'").collect()} == known

    headers = header.withColumn("run_id", F.lit("few_shot")).unionByName(header.withColumn("run_id", F.lit("lost")))
    all_samples = predicted.withColumn("run_id", F.lit("few_shot")).unionByName(predicted.withColumn("run_id", F.lit("lost")))
    table = R.run_comparison(headers, all_samples, reports).collect()
    assert len(table) == 1
    assert (table[0].total_tokens, table[0].samples, table[0].latency, table[0].max_tokens) == (180, 60, 0.5, 16)
    assert table[0].accuracy == pytest.approx(R.report_row(report, "accuracy").first().precision)
    assert [r.run_id for r in R.missing_runs(headers, reports).collect()] == ["lost"]


def test_plain_report_files(spark, tmp_path):
    run = tmp_path / "run 1+é"
    run.mkdir()
    body = ",precision,recall,f1-score,support\n0,0.5,1.0,0.6,2.0\naccuracy,0.75,0.75,0.75,0.75\nmacro avg,0.1,0.2,0.3,4.0\nweighted avg,0.4,0.5,0.6,4.0\n"
    (run / "evaluation.csv").write_text(body)
    (run / "evaluation_part.csv").write_text(body.replace("0.75", "0.25"))
    reports = runs.read_reports(spark, str(run), default_label="naturetitle")
    assert {(r.run_id, r.label_name) for r in reports.collect()} == {("run 1+é", "naturetitle"), ("run 1+é", "part")}
    averages = R.average_metrics(reports).first()
    assert (averages.accuracy, averages.precision_macro, averages.f1_weighted) == (0.5, 0.1, 0.6)


def test_run_documents_of_any_version(spark, tmp_path):
    response = {"text": '{"a": 1}', "prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3, "latency": 0.5, "reasoning": "why", "exception": None, "extra": 1}
    new = {
        "config": {"technique_name": "New", "max_tokens": 4, "claude_thinking_tokens": 9, "later_field": True},
        "texts": ["t0", "t1"], "labels_pred": {"k": [0, 1], "p": [1, 1]}, "labels_true": {"k": [0, 0], "p": [1, 0]},
        "label_names": {"k": ["a", "b"], "p": ["x", "y"]}, "llm_responses": [response, response],
        "total_tokens": 6, "total_time_elapsed": 1.5,
    }
    old = {
        "config": {"name": "Old", "max_tokens": 4}, "texts": ["t0", "é"], "labels_pred": [0, 1], "labels_true": [1, 1],
        "label_names": ["a", "b"], "llm_responses": ["bare", '{"looks": "like json"}'], "total_time_elapsed": 2.0,
    }
    for name, data in (("new", new), ("old", old)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "raw_output.json").write_text(json.dumps(data, ensure_ascii=False, indent=4))
    documents = runs.read_run_documents(spark, f"{tmp_path}/*/raw_output.json", default_label="k")
    headers = {r.config.technique_name: r for r in runs.document_headers(documents).collect()}
    assert headers["New"].config.thinking_tokens == 9
    assert headers["Old"].label_names == {"k": ["a", "b"]} and headers["Old"].total_time_elapsed == 2.0
    samples = runs.document_samples(documents, ["k", "p"]).orderBy("run_id", "sample_id").collect()
    first, _, third, fourth = samples
    assert first.response.text == '{"a": 1}' and first.response.reasoning == "why" and first.response.total_tokens == 3
    assert (first.predicted.k, first.predicted.p, samples[1].actual.p) == (0, 1, 0)
    assert (third.response.text, third.response.total_tokens, third.response.latency) == ("bare", 0, 0.0)
    assert (fourth.text, fourth.response.text, fourth.actual.k, fourth.predicted.p) == ("é", '{"looks": "like json"}', 1, None)


def test_missing_report_folders_are_listed(spark, tmp_path):
    report = spark.createDataFrame([("0", "kind", 1.0, 1.0, 1.0, 2.0)], "row_key string, label_name string, precision double, recall double, f1 double, support double")
    runs.write_reports(report, ["kind"], str(tmp_path / "here"))
    folders = [str(tmp_path / "here"), str(tmp_path / "lost")]
    with pytest.warns(UserWarning, match="lost"):
        rows = runs.read_reports(spark, folders).collect()
    assert [(r.run_id, r.label_name, r.row_key) for r in rows] == [("here", "kind", "0")]
    with pytest.warns(UserWarning, match="lost"):
        assert runs.read_reports(spark, folders[1]).count() == 0


def test_load_labelled_without_joining_lines(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text, {i}", "a" if i % 2 else "b") for i in range(20)], "id long, text string, label string")
    path = str(tmp_path / "t.csv")
    tables.write_csv(df, path)
    one, two = (tables.load_labelled(spark, path, "text", "label", keys="id", multi_line=m)[0] for m in (True, False))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and two.count() == 20


def test_reports_of_many_runs_are_one_write(spark, tmp_path):
    schema = "run string, row_key string, label_name string, precision double, recall double, f1 double, support double"
    rows = [(f"run {i}=é%", str(k), label, i / 8, 0.5, 0.25, float(k)) for i in range(7) for label in ("Kind of", "part") for k in range(3)]
    report, out = spark.createDataFrame(rows, schema), str(tmp_path / "out")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for _ in range(2):  # an old report is replaced
        runs.write_reports(report, ["Kind of", "part"], out, run="run")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 6
    assert sorted(f.name for f in (tmp_path / "out" / "run 3=é%").glob("*.csv")) == ["evaluation_kind_of.csv", "evaluation_part.csv"]
    assert (tmp_path / "out" / "run 3=é%" / "evaluation_part.csv").is_file() and not list((tmp_path / "out").glob("_reports*"))
    back = {(r.run_id, r.row_key, r.label_name, r.precision, r.support) for r in runs.read_reports(spark, f"{out}/*").collect()}
    assert back == {(run, key, {"Kind of": "kind_of"}.get(label, label), p, s) for run, key, label, p, _, _, s in rows}
    with pytest.raises(ValueError, match="same file name"):
        runs.write_reports(report, ["Kind of", "kind_of"], out, run="run")


@pytest.mark.parametrize("multi_line", [True, False])
def test_empty_text_and_null_differ(spark, tmp_path, multi_line):
    rows = [(1, ""), (2, None), (3, " "), (4, "a,\"b\"")]
    df = spark.createDataFrame(rows, "id int, text string")
    tables.write_csv(df, str(tmp_path / "t"))
    back = tables.read_csv(spark, str(tmp_path / "t"), df.schema, multi_line=multi_line)
    assert sorted((r.id, r.text) for r in back.collect()) == rows


def quoted(value):
    return "" if value is None else '"' + value.replace('"', '""') + '"' if value == "" or set(value) & set('",\n\r') else value


@pytest.mark.parametrize("block", ["64b", "1k", "64m"])
def test_records_over_lines_in_many_blocks(spark, tmp_path, block):
    draw = random.Random(6)
    pieces = ["a", "é", "\n", '"', ",", "\r\n", " ", "long line of text " * 6, "\n\n", '""']
    want = [(i, draw.choice([None, "", "".join(draw.choice(pieces) for _ in range(draw.randint(1, 8))).strip(" ") or "x"]), draw.random()) for i in range(400)]
    for part in range(3):
        lines = ["Title, with \" a quote", "", "id,a text,x"] + [f"{i},{quoted(t)},{x}" for i, t, x in want[part::3]]
        (tmp_path / f"p{part}.csv").write_bytes("\n".join(lines).encode() + (b"\n" if part else b""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = tables.read_csv_after(spark, str(tmp_path), 2)
        assert rows.columns == ["id", "a text", "x"]
        assert sorted((int(r[0]), r[1], float(r[2])) for r in rows.collect()) == sorted(want)
        if block == "64b":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_blocks_beyond_the_small_bounds(spark, tmp_path, monkeypatch):
    want = [(i, f"line\n{i}") for i in range(500)]
    (tmp_path / "t.csv").write_text("id,t\n" + "".join(f'{i},"{t}"\n' for i, t in want))
    monkeypatch.setattr(session, "small_rows", lambda df, max_rows=0: None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    try:
        assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t.csv"), "id int, t string").collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_different_headers_are_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n1,x\n")
    (tmp_path / "b.csv").write_text("t,id\nx,1\n")
    with pytest.raises(ValueError, match="different headers"):
        tables.read_csv(spark, str(tmp_path))
