"""Labelled tables from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.operators.chat import preprocess_chat
from labelspark.operators.labels import labelled_dataset
from labelspark.operators.sampling import balance_classes, check_sample_size, sample_rows
from labelspark.operators.splits import one_split, random_split
from labelspark.session import as_list
from labelspark.sources.csv_records import csv_records, guessed_types

FORMATS = ("csv", "json", "parquet")
# Words that data-frame libraries read as "no value" in a CSV file.
MISSING_WORDS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SPLIT = "split"


# How a record is read: a marker that no file holds stands for no value; the reader takes empty fields for it, and
# quoted empty ones not.
_CSV = {"escape": '"', "nullValue": "\0\0"}


def _named(spark: SparkSession, header: str) -> list[str]:
    one = spark.createDataFrame([(header,)], "value string")
    width = len(T.DataType.fromDDL(one.select(F.schema_of_csv(F.lit(header), _CSV)).first()[0]).fields)
    blank = ", ".join(f"_c{i} string" for i in range(width))
    names = one.select(F.from_csv("value", F.lit(blank), _CSV)).first()[0].asDict()
    return [name or place for place, name in names.items()]


def _parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Records as columns, those that the folders' names hold last."""
    folders = {c: F.col(f"`{c}`") for c in records.columns[1:]}
    own = [f for f in schema.fields if f.name not in folders]
    folders |= {f.name: folders[f.name].cast(f.dataType) for f in schema.fields if f.name in folders}
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in own)
    parsed = records.select(F.from_csv("record", F.lit(ddl), _CSV).alias("_r"), *[v.alias(c) for c, v in folders.items()])
    return parsed.select("_r.*", *[F.col(f"`{c}`") for c in folders])


def read_csv(spark: SparkSession, path, schema=None, missing=(), multi_line: bool = True) -> DataFrame:
    """CSV with a header; quoted fields may hold quotes and line breaks. An empty field is null, a quoted
    empty one is the empty text.

    Large files are read by many tasks, also where records span lines. Give a schema where you can: without one all
    values are read once more to guess the types. ``missing`` lists words that stand for no value in text columns.
    ``multi_line=False`` leaves the joining of lines out, which is quicker where no record spans lines.
    """
    if multi_line:
        header, records = csv_records(spark, path)
        if schema is None:
            texts = T.StructType([T.StructField(n, T.StringType()) for n in (_named(spark, header) if header else [])])
            rows = _parsed(records, texts) if header else spark.createDataFrame([], texts)
            kinds = guessed_types(rows.select(*[F.col(f"`{c}`") for c in texts.names])) if header else {}
            rows = rows.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in kinds.items()})
        else:
            rows = _parsed(records, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    else:
        reader = spark.read.option("header", True).options(**_CSV)
        rows = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    text = [f.name for f in rows.schema.fields if missing and isinstance(f.dataType, T.StringType)]
    return rows.withColumns({c: F.when(~F.col(f"`{c}`").isin(list(missing)), F.col(f"`{c}`")) for c in text})


def write_csv(df: DataFrame, path: str, partition_by=()) -> None:
    """CSV that ``read_csv`` gives back unchanged, blanks, nulls and empty texts included."""
    writer = (
        df.write.mode("overwrite").option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )
    by = as_list(partition_by)
    (writer.partitionBy(*by) if by else writer).csv(path)


def read_csv_after(spark: SparkSession, path, skip: int, columns=None) -> DataFrame:
    """CSV whose header follows ``skip`` preamble lines in every file; all columns are strings.

    A file may be split over many tasks, and records may span lines. All files have the same header.
    """
    header, records = csv_records(spark, path, skip)
    if header is None:
        raise ValueError(f"no header after {skip} lines in {path}")
    rows = _parsed(records, T.StructType([T.StructField(n, T.StringType()) for n in _named(spark, header)]))
    return rows.select(*[F.col(f"`{c}`") for c in as_list(columns)]) if columns else rows


def read_table(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """A table by the suffix of its path: csv, json or parquet.

    In CSV files the usual words for a missing value are read as null; ``multi_line`` is that of :func:`read_csv`.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"{path}: expected a .csv, .json or .parquet path")
    if kind == "csv":
        return read_csv(spark, path, schema, MISSING_WORDS, multi_line)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path) if kind == "json" else reader.parquet(path)


def prepare_labelled(
    df: DataFrame,
    text_cols,
    label_cols,
    test_size: float = 0,
    balanced: bool = False,
    ratio: float | None = None,
    size: int | None = None,
    split: str | None = None,
    keys=None,
    seed: int = 42,
    compact: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Clean, split, sample or balance, and convert to chat records: ``(messages, vocabulary)``.

    The split comes before sampling, so every split is sampled on its own. ``split`` picks one
    split of a table that already has them.
    """
    if ratio is not None or size is not None:
        check_sample_size(ratio, size)
    keys = as_list(keys)
    has_split = SPLIT in df.columns and SPLIT not in [*as_list(text_cols), *as_list(label_cols)]
    if split is not None:
        if not has_split:
            raise ValueError("the table has no split column")
        df, has_split = one_split(df, split), False
    extra = [k for k in keys if k not in [*as_list(text_cols), *as_list(label_cols)]]
    rows = labelled_dataset(df, text_cols, label_cols, extra=[*extra, *([SPLIT] if has_split else [])])
    if test_size and not has_split:
        rows, has_split = random_split(rows, test_size, keys or None, seed), True
    splits = SPLIT if has_split else None
    if ratio is not None or size is not None:
        if balanced:
            rows = balance_classes(rows, label_cols, ratio, size, keys=keys or None, seed=seed, split_col=splits)
        else:
            rows = sample_rows(rows, ratio, size, keys or None, seed, splits)
    return preprocess_chat(rows, text_cols, label_cols, keep=[*extra, *as_list(splits)], compact=compact)


def load_labelled(spark: SparkSession, path: str, text_cols, label_cols, schema=None, multi_line: bool = True, **options):
    """``prepare_labelled`` on a csv, json or parquet path, read as by :func:`read_table`."""
    return prepare_labelled(read_table(spark, path, schema, multi_line), text_cols, label_cols, **options)


def write_splits(df: DataFrame, path: str, split_col: str = SPLIT) -> None:
    """One CSV folder per split; readers of a split open its files only."""
    write_csv(df, path, split_col)
