"""Session set-up, the shared scratch folder, and the size check behind every broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table is broadcast (or read by the driver) only below all three bounds.
SMALL_ROWS = 20_000
SMALL_CHARS = 4_096
SMALL_BYTES = 32 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8, folder: str | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own.

    ``folder`` takes intermediate tables; without it they go to a temporary folder, which is removed
    when the program ends.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("labelspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return (builder.config("spark.checkpoint.dir", folder) if folder else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: executors on other machines
    could not read it.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="labelspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/labelspark/{uuid.uuid4().hex}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Like ``checkpoint()`` it cuts the lineage and survives the loss of executors; being columnar,
    a pass that needs one column reads one column.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_rows(df: DataFrame, max_rows: int = SMALL_ROWS):
    """The rows of ``df`` as an Arrow table, or None when they exceed the small-table bounds.

    At most ``max_rows + 1`` rows travel, and strings are cut one character past the bound on
    the way, so the check itself is bounded whatever ``df`` holds.
    """
    cut = [
        F.substring(F.col(f"`{f.name}`"), 1, SMALL_CHARS + 1).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    table = df.select(*cut).limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > SMALL_BYTES:
        return None
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            if any(v is not None and len(v) > SMALL_CHARS for v in table[f.name].to_pylist()):
                return None
    return table


@dataclass(frozen=True)
class Settled:
    """A computed table that knows whether it was measured to be small."""

    df: DataFrame
    table: pa.Table | None

    @property
    def small(self) -> bool:
        return self.table is not None

    def biggest(self, *columns: str) -> list:
        """The maximum of each column, None where there is no value."""
        if self.table is not None:
            return [pc.max(self.table[c]).as_py() if self.table.num_rows else None for c in columns]
        return list(self.df.agg(*[F.max(f"`{c}`") for c in columns]).first())

    def side(self, derived: DataFrame | None = None) -> DataFrame:
        """The table, or a projection or filter of it, as a join side: broadcast only if small."""
        df = self.df if derived is None else derived
        return F.broadcast(df) if self.small else df


def settle_if_small(df: DataFrame) -> Settled | None:
    """``df`` computed once, if it is within the small-table bounds."""
    table = small_rows(df)
    if table is None:
        return None
    return Settled(df.sparkSession.createDataFrame(table, schema=df.schema), table)


def settle(df: DataFrame) -> Settled:
    """Compute ``df`` once and measure it.

    A table beyond the small-table bounds is checkpointed and left to a shuffle join, where the
    adaptive planner splits skewed keys.
    """
    return settle_if_small(df) or Settled(checkpointed(df), None)


def join_groups(rows: DataFrame, table: Settled, keys, how: str = "inner") -> DataFrame:
    """Attach the columns of a settled table to every row of the same group, nulls included."""
    keys = as_list(keys)
    renamed = table.df
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_g{i}")
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(f"`{k}`").eqNullSafe(F.col(f"_g{i}"))
    if not keys:
        row = table.df.first()
        return rows.select("*", *[
            F.lit(row[f.name] if row else None).cast(f.dataType).alias(f.name) for f in table.df.schema.fields
        ])
    joined = rows.join(table.side(renamed), condition, how)
    return joined.drop(*[f"_g{i}" for i in range(len(keys))])


def as_list(columns) -> list[str]:
    """Scalar-or-list argument to list."""
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def require_columns(df: DataFrame, columns) -> None:
    """Name a missing column before any job starts."""
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"no such column: {c}")
