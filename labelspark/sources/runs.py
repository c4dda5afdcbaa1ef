"""Evaluation runs on disk: the header, one record per sample, reports and answers.

A run folder holds ``run`` (one JSON line), ``samples`` (JSON lines), ``answers.csv``,
``incorrect_answers.csv`` and one ``evaluation_<label>.csv`` per label. Older runs are single
JSON documents with parallel lists; they are read into the same two tables.
"""

from __future__ import annotations

import uuid
import warnings
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.functions.text import slug_text
from labelspark.operators.errors import answers
from labelspark.plans.config import CONFIG_TYPE, RunConfig
from labelspark.plans.inference import RESPONSE_TYPE
from labelspark.session import as_list
from labelspark.sources.tables import write_csv

# Columns and layout of report files.
REPORT_SCHEMA = "row_key string, precision double, recall double, `f1-score` double, support double"
REPORT_NAME = r"evaluation_(.*?)\.csv"

_IDS = "map<string,array<int>>"
_NAMES = "map<string,array<string>>"


def _file_path() -> Column:
    """Path of the file a row comes from, with blanks and the like as they are on disk."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def run_folder(out: str | None, technique_name: str) -> str:
    """Folder of a run: the file-safe technique name under the output folder."""
    name = slug_text(technique_name)
    return f"{out.rstrip('/')}/{name}" if out else name


def write_run(predictions: DataFrame, vocab: dict[str, list[str]], config: RunConfig, counts_report: DataFrame,
              keys, elapsed: float, out: str | None = None) -> str:
    """Write header, samples, reports and answers of one run; returns its folder."""
    folder = run_folder(out or config.out_path, config.technique_name)
    write_header(predictions.sparkSession, config, vocab, elapsed, f"{folder}/run")
    write_samples(predictions, f"{folder}/samples")
    write_reports(counts_report, list(vocab), folder)
    write_csv(answers(predictions, vocab, keys), f"{folder}/answers.csv")
    write_csv(answers(predictions, vocab, keys, wrong_only=True), f"{folder}/incorrect_answers.csv")
    return folder


def write_header(spark: SparkSession, config: RunConfig, vocab: dict[str, list[str]], elapsed: float, path: str) -> None:
    """Configuration, vocabulary and elapsed time as one JSON line."""
    schema = f"config {CONFIG_TYPE}, label_names {_NAMES}, total_time_elapsed double"
    row = (tuple(config.to_dict().values()), vocab, float(elapsed))
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(path)


def write_samples(predictions: DataFrame, path: str) -> None:
    """One JSON line per sample; no run passes through one task."""
    predictions.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_headers(spark: SparkSession, path) -> DataFrame:
    """Run headers; fields of other versions are ignored."""
    schema = f"config {CONFIG_TYPE}, label_names {_NAMES}, total_time_elapsed double"
    return spark.read.schema(schema).json(path)


def read_samples(spark: SparkSession, path, labels, keys: str) -> DataFrame:
    """Samples of a run; ``keys`` is the DDL of the key columns."""
    ids = "struct<" + ",".join(f"`{c}`:int" for c in labels) + ">"
    schema = f"{keys}, text string, truth string, response {RESPONSE_TYPE}, predicted {ids}, actual {ids}"
    return spark.read.schema(schema).json(path)


def _either(text: Column, map_type: str, list_type: str, label: str) -> Column:
    """A map by label, or the bare list of an older file as the list of one label."""
    bare = F.map_from_arrays(F.array(F.lit(label)), F.array(F.from_json(text, list_type)))
    return F.when(text.startswith("["), bare).otherwise(F.from_json(text, map_type))


def _response(entry: Column) -> Column:
    """A response record, or the bare answer text of an older file with zero counts."""
    zero = F.lit(0)
    bare = F.struct(
        F.variant_get(entry, "$", "string"), zero, zero, zero, F.lit(0.0),
        F.lit(None).cast("string"), F.lit(None).cast("string"),
    ).cast(RESPONSE_TYPE)
    get = lambda name, kind: F.try_variant_get(entry, f"$.{name}", kind)
    record = F.struct(
        get("text", "string"), get("prompt_tokens", "int"), get("completion_tokens", "int"),
        get("total_tokens", "int"), get("latency", "double"), get("reasoning", "string"),
        get("exception", "string"),
    ).cast(RESPONSE_TYPE)
    return F.when(F.schema_of_variant(entry) == "STRING", bare).otherwise(record)


def read_run_documents(
    spark: SparkSession, path, pretty: bool = True, default_label: str = "label"
) -> DataFrame:
    """Run documents of any version, one row each.

    ``config.name`` is read as the technique name, bare label lists as those of
    ``default_label``, bare answers as responses without counts; unknown fields are ignored.
    """
    config = CONFIG_TYPE.replace("struct<", "struct<name:string,claude_thinking_tokens:int,", 1)
    raw = spark.read.schema(
        f"run_id string, config {config}, texts array<string>, labels_pred string, labels_true string, "
        "label_names string, llm_responses array<variant>, total_time_elapsed double"
    ).option("multiLine", pretty).json(path)
    c = F.col("config")
    upgraded = F.struct(
        F.coalesce(c["technique_name"], c["name"]), c["max_tokens"], c["prompt"], c["prompt_role"],
        c["temperature"], c["top_p"], c["reasoning_effort"],
        F.coalesce(c["thinking_tokens"], c["claude_thinking_tokens"]), c["out_path"],
    ).cast(CONFIG_TYPE)
    return raw.select(
        F.coalesce("run_id", _file_path()).alias("run_id"),
        upgraded.alias("config"), "texts",
        _either(F.col("labels_pred"), _IDS, "array<int>", default_label).alias("labels_pred"),
        _either(F.col("labels_true"), _IDS, "array<int>", default_label).alias("labels_true"),
        _either(F.col("label_names"), _NAMES, "array<string>", default_label).alias("label_names"),
        F.transform("llm_responses", _response).alias("llm_responses"),
        "total_time_elapsed",
    )


def document_headers(documents: DataFrame) -> DataFrame:
    """The header table of run documents."""
    return documents.select("run_id", "config", "label_names", "total_time_elapsed")


def document_samples(documents: DataFrame, labels) -> DataFrame:
    """The parallel lists of run documents as one row per sample."""
    none = F.array().cast("array<int>")  # a run without the label still has its other samples
    pred = [F.coalesce(F.col("labels_pred").getItem(c), none).alias(f"_p{i}") for i, c in enumerate(labels)]
    true = [F.coalesce(F.col("labels_true").getItem(c), none).alias(f"_t{i}") for i, c in enumerate(labels)]
    flat = documents.select("run_id", "texts", "llm_responses", *pred, *true)
    lists = ["texts", "llm_responses", *[f"_p{i}" for i in range(len(labels))], *[f"_t{i}" for i in range(len(labels))]]
    rows = flat.select("run_id", F.posexplode(F.arrays_zip(*lists)).alias("sample_id", "s"))
    return rows.select(
        "run_id", "sample_id", F.col("s.texts").alias("text"), F.col("s.llm_responses").alias("response"),
        F.struct(*[F.col(f"s._p{i}").alias(c) for i, c in enumerate(labels)]).alias("predicted"),
        F.struct(*[F.col(f"s._t{i}").alias(c) for i, c in enumerate(labels)]).alias("actual"),
    )


def write_reports(report: DataFrame, labels, folder: str, run: str | None = None) -> None:
    """One file ``evaluation_<label>.csv`` per label, in the layout of report files; with ``run``, the column that
    names a run, in a folder per run.

    All reports are one job, whatever their number: they are written by run and label beside the reports, and the
    files then take their names. A report that exists is replaced. Names of runs are not null or empty and are no paths.
    """
    labels = as_list(labels)
    if len({slug_text(c) for c in labels}) < len(labels):
        raise ValueError("labels with the same file name")
    spark = report.sparkSession
    file = F.element_at(F.create_map(*[F.lit(v) for c in labels for v in (c, slug_text(c))]), F.col("label_name"))
    rows = report.where(F.col("label_name").isin(labels)).select(
        F.col("row_key").alias("row_key"), "precision", "recall", F.col("f1").alias("f1-score"), "support",
        (F.col(f"`{run}`").cast("string") if run else F.lit("_")).alias("_run"), file.alias("_file"))
    staged = f"{folder.rstrip('/')}/_reports-{uuid.uuid4().hex}"
    write_csv(rows.repartition("_run", "_file"), staged, ["_run", "_file"])
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    made = set()
    for found in fs.globStatus(path(f"{staged}/_run=*/_file=*/part-*")):
        part = found.getPath()
        file, run_name = (unquote(p.getName().split("=", 1)[1]) for p in (part.getParent(), part.getParent().getParent()))
        home = path(path(folder), run_name) if run else path(folder)
        target = path(home, f"evaluation_{file}.csv")
        if target.toString() in made:
            raise ValueError(f"more than one file for {target}")
        made.add(target.toString())
        fs.mkdirs(home)
        fs.delete(target, True)
        if not fs.rename(part, target):
            raise OSError(f"cannot write {target}")
    fs.delete(path(staged), True)


def _report_glob(folder: str) -> str:
    return f"{folder.rstrip('/')}/evaluation{{,_*}}.csv"


def report_folders(spark: SparkSession, folders) -> tuple[list[str], list[str]]:
    """Of the given folders (or patterns) those that hold reports, and those that don't."""
    found, missing = [], []
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(_report_glob(folder))
        matches = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        (found if matches else missing).append(folder)
    return found, missing


def read_reports(spark: SparkSession, folders, default_label: str = "label") -> DataFrame:
    """All reports of many run folders in one scan: ``(run_id, label_name, row_key, …)``.

    The run is the name of the folder and the label comes from the file name, with a default
    for files named ``evaluation.csv``. Folders without reports are skipped with a warning that
    lists them; ``report_folders`` tells them apart beforehand.
    """
    paths = [folders] if isinstance(folders, str) else list(folders)
    found, missing = report_folders(spark, paths)
    if missing:
        warnings.warn(f"no reports in {', '.join(missing)}")
    if not found:
        return spark.createDataFrame([], "run_id string, label_name string, row_key string, precision double, recall double, f1 double, support double")
    globs = [_report_glob(p) for p in found]
    rows = spark.read.option("header", True).option("escape", '"').schema(REPORT_SCHEMA).csv(globs)
    file = _file_path()
    named = F.regexp_extract(file, REPORT_NAME, 1)
    return rows.select(
        F.regexp_extract(file, r"([^/]+)/evaluation(?:_[^/]*)?\.csv", 1).alias("run_id"),
        F.when(named != "", named).otherwise(F.lit(default_label)).alias("label_name"),
        "row_key", "precision", "recall", F.col("f1-score").alias("f1"), "support",
    )
