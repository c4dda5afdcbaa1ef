"""WARC archives in which equal payloads are stored once.

Headers (id, length, digest of the payload), never payloads, are shuffled by digest; the record with
the largest id of each group keeps its payload, and the others are joined to it and become revisit
records. Archives are written by Spark's own writer, a record per row, so a lost executor's files are
written again and only whole tasks are committed. Reading parses the archives record by record and
resolves revisits by joining them to the responses that they refer to.

Defined results: a null payload is empty; payloads under ``LEAST_BYTES`` are never deduplicated; rows
that repeat both id and payload get the same record; rows without an id may be revisits, but nothing
refers to them; a null URL has no field, and line ends in a URL are percent-encoded; an empty table
gives archives without records, which read as an empty table; only the three named columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.session import checkpointed

LEAST_BYTES = 1_000
# Bytes of payloads in a file before compression, by their average; and bounds of a batch that is read.
FILE_BYTES = 128 << 20
BATCH_RECORDS, BATCH_BYTES = 1_000, 16 << 20

# Fixed names of the format; the fields of this package begin with its name.
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID, _REFERS, _BYTES = "Labelspark-Id", "Labelspark-Refers-To-Id", "Labelspark-Payload-Length"
_END = "\r\n"


def headers_of(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``(id, digest, bytes)`` of every row, written once."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return checkpointed(pages.select(
        F.col(id_col).alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")))


def resolve_revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``(id, digest, original)`` of the rows that become revisits, each id and digest once."""
    headers = headers.where(F.col("bytes") >= least_bytes)
    originals = headers.groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null")
    revisits = headers.join(originals.drop("n"), "digest").where("id is null or id <> original")
    return revisits.select("id", "digest", "original").distinct()


def _record_id(id_: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws("|", F.coalesce(id_.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "1970-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> None:
    """One record per row into gzip-compressed archives below ``path``, which must not exist."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    headers = headers_of(pages, id_col, payload_col)
    average = headers.agg(F.avg("bytes")).first()[0] or 0
    revisits = resolve_revisits(headers, least_bytes).select(
        F.col("id").alias("_id"), F.col("digest").alias("_digest"), "original")
    joined = rows.join(revisits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(_END * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))  # noqa: E731  null without a value
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [
        F.lit(_VERSION + _END),
        F.when(revisit, F.lit(f"WARC-Type: revisit{_END}WARC-Profile: {_PROFILE}{_END}")).otherwise(F.lit(f"WARC-Type: response{_END}")),
        field("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}{_END}"),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("WARC-Refers-To", F.when(revisit, _record_id(F.col("original"), F.col("digest")))),
        field(_REFERS, F.col("original").cast("string")),
        field(_ID, F.col("id").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{_END}"),
        field("Content-Length", F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws("", *fields), F.lit(_END), block)
    # The writer puts the record's end, two line ends, after each value.
    joined.select(record.alias("value")).write.option("lineSep", _END * 2).option("compression", "gzip").option(
        "maxRecordsPerFile", max(1, int(FILE_BYTES // (average + 1_000)))).text(path)


def records(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of every record; broken archives are refused."""
    while line := file.readline():
        if line.strip() != _VERSION.encode():
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := file.readline()) != b"\r\n":
            if not line:
                raise ValueError("an archive ends within a record's fields")
            name, _, value = line.decode().partition(":")
            fields[name.strip()] = value.strip()
        size = int(fields["Content-Length"])
        block = file.read(size)
        if len(block) != size or file.read(4) != b"\r\n\r\n":
            raise ValueError("an archive ends within a record's block")
        yield fields, block


def read_archives(spark: SparkSession, path: str, payloads: bool = True, id_type: str = "bigint") -> DataFrame:
    """``(id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])`` of every record.

    Digests of stored payloads are computed again and must agree with the field; a revisit gets the
    length (and payload) of the response it refers to.
    """
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                with gzip.open(io.BytesIO(memoryview(content.as_buffer()))) as file:
                    for fields, block in records(file):
                        body = block[block.index(b"\r\n\r\n") + 4:]
                        kind, claimed = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(body).hexdigest() != claimed:
                            raise ValueError(f"a payload differs from its digest {claimed}")
                        row = [fields.get(_ID), fields.get("WARC-Target-URI"), len(body) if kind == "response" else None,
                               claimed, kind, fields.get(_REFERS)]
                        if payloads:
                            row.append(body.decode(errors="replace") if kind == "response" else None)
                        rows.append(row)
                        held += len(body) * payloads
                        if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
                            yield _batch(rows, names)
                            rows, held = [], 0
                yield _batch(rows, names)

    kinds = ", ".join(f"{n} {'bigint' if n == 'payload_bytes' else 'string'}" for n in names)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(parse, kinds)
    found = found.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})
    taken = ["payload_bytes"] + ["payload"] * payloads
    originals = found.where("record_type = 'response' and id is not null").select(
        F.col("id").alias("_id"), F.col("payload_digest").alias("_digest"), *[F.col(c).alias(f"_{c}") for c in taken]
    ).dropDuplicates(["_id", "_digest"])
    same = (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest"))
    revisits = found.where("record_type = 'revisit'").drop(*taken).join(originals, same, "left")
    resolved = revisits.select(*[F.col(f"_{c}").alias(c) if c in taken else F.col(c) for c in names])
    return found.where("record_type <> 'revisit'").select(names).union(resolved)


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for c, n in zip(columns, names, strict=True)], names)
