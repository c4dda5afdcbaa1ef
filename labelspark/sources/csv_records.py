"""CSV whose records may span lines, read by many tasks per file.

Files are read line by line, in blocks. A block does not know whether it starts inside a quoted field, so the quotes of
each block are counted first; the running sum over the blocks of a file tells. Each task then joins the lines of its
records. A record that lies in several blocks is put together from its pieces, at most two of each block.

Quotes stand around whole fields and are doubled within them. Lines end with a line feed, with or without a carriage
return; inside quotes both stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark.session import checkpointed, settle

_HEAD, _BODY, _TAIL, _WHOLE = "head", "body", "tail", "whole"
_KINDS = {"int": "int", "bigint": "bigint", "double": "double", "date": "date", "timestamp": "timestamp", "boolean": "boolean"}


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines in file order within a task, with file and block, and what the folders' names say."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("_file"), meta["file_block_start"].alias("_block"), "*")


def _blocks(batches: Iterator[pa.RecordBatch], skip: int, inside) -> Iterator[tuple]:
    """``(file, block, line, starts inside quotes)`` for all lines but the first ``skip`` of a file."""
    at, seen, odd = None, 0, False
    for batch in batches:
        states = batch["inside"].to_pylist() if inside else [False] * len(batch)
        for file, block, line, starts in zip(batch["_file"].to_pylist(), batch["_block"].to_pylist(), batch["value"].to_pylist(), states):
            if at != (file, block):
                at, seen, odd = (file, block), 0, bool(starts)
            seen += 1
            if block or seen > skip:
                yield file, block, line, odd
                odd ^= line.count('"') & 1 == 1


def _quotes(skip: int):
    """Quotes per block, and of a file's first block the record after the skipped lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, list] = {}
        for file, block, line, inside in _blocks(batches, skip, False):
            found = counts.setdefault((file, block), [0, [], False])
            found[0] += line.count('"')
            if not block and not found[2]:
                found[1].append(line)
                found[2] = not inside ^ (line.count('"') & 1 == 1)
        rows = [(f, b, n, "\n".join(lines).rstrip("\r") if done else None) for (f, b), (n, lines, done) in counts.items()]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["_file", "_block", "quotes", "header"])

    return run


def _records(skip: int):
    """Whole records of a block, and the pieces at its ends that belong to records of several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at, held, starts, first = None, [], False, True

        def close() -> None:
            if held:
                rows.append((*at, _WHOLE if starts else _TAIL, "\n".join(held)))

        for file, block, line, inside in _blocks(batches, skip, True):
            if at != (file, block):
                close()
                at, held, starts, first = (file, block), [], inside, not block
            held.append(line)
            if not inside ^ (line.count('"') & 1 == 1):
                record = "\n".join(held)
                if first and not starts:
                    first = False  # the header
                elif starts or record.strip():
                    rows.append((file, block, _HEAD if starts else _BODY, record))
                held, starts = [], False
            if len(rows) >= 4_096:
                yield _batch(rows)
                rows.clear()
        close()
        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["_file", "_block", "kind", "record"])


def csv_records(spark: SparkSession, path, skip: int = 0) -> tuple[str | None, DataFrame]:
    """The header that all files share, and all other records as ``(record)``; blank records are left out.

    Columns that the folders' names hold follow. ``skip`` lines before the header of each file are passed over. Without
    any file with a header the first is None.
    """
    given = _lines(spark, path)
    folders = given.columns[3:]
    lines = given.select("_file", "_block", "value")
    blocks = settle(lines.mapInArrow(_quotes(skip), "_file string, _block bigint, quotes bigint, header string"))
    headers = [r.header for r in blocks.df.where("header is not null").select("header").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"the files in {path} have different headers: {headers[0]!r} and {headers[1]!r}")
    before = F.sum("quotes").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    states = blocks.df.select("_file", "_block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))
    known = lines if blocks.small else lines.withColumn("line", F.monotonically_increasing_id())
    known = known.join(blocks.side(states), ["_file", "_block"])
    if not blocks.small:
        # So many blocks that their states are joined by a shuffle: put the lines of each block in order again.
        known = known.repartition("_file", "_block").sortWithinPartitions("_file", "_block", "line").drop("line")
    found = known.select("_file", "_block", "value", "inside").mapInArrow(_records(skip), "_file string, _block bigint, kind string, record string")
    pieces = checkpointed(found.where(F.col("kind") != _BODY))
    begun = F.last(F.when(F.col("kind") == _TAIL, F.col("_block")), ignorenulls=True).over(
        Window.partitionBy("_file").orderBy("_block", "kind").rowsBetween(Window.unboundedPreceding, 0))
    # Of one block the end of a record comes before the beginning of the next: "head" before "tail".
    grouped = pieces.withColumn("begun", begun).groupBy("_file", "begun").agg(F.array_sort(F.collect_list(F.struct("_block", "kind", "record"))).alias("p"))
    joined = grouped.select("_file", F.array_join(F.transform("p", lambda p: p["record"]), "\n").alias("record"))
    records = found.where(F.col("kind") == _BODY).select("_file", "record").unionByName(joined)
    records = records.withColumn("record", F.rtrim(F.col("record"), F.lit("\r")))
    if folders:
        files = settle(given.select("_file", *[F.col(f"`{c}`") for c in folders]).distinct())
        records = records.join(files.side(), "_file")
    return (headers[0] if headers else None), records.drop("_file")


def guessed_types(rows: DataFrame) -> dict[str, str]:
    """The narrowest type of text columns that all values can be read as, by one aggregation."""
    checks = []
    for i, c in enumerate(rows.columns):
        value = F.col(f"`{c}`")
        checks.append(F.count(value).alias(f"n{i}"))
        for kind in _KINDS:
            fits = value.try_cast(kind).isNotNull()
            if kind in ("date", "timestamp"):
                fits = fits & value.rlike(r"^\d{4}-\d{2}-\d{2}" + ("$" if kind == "date" else ""))
            checks.append(F.count(F.when(fits, 1)).alias(f"{kind}{i}"))
    found = rows.agg(*checks).first()
    types = {}
    for i, c in enumerate(rows.columns):
        n = found[f"n{i}"]
        types[c] = next((k for k in _KINDS if n and found[f"{k}{i}"] == n), "string")
    return types
