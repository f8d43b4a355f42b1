"""Reading and materialising tables: explicit schemas, first file that exists, freshness, cache or refresh."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.sources import snapshots


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header under an explicit schema; bad values are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def first_two_columns(spark: SparkSession, path: str, names: tuple[str, str]) -> DataFrame:
    """The first two fields of a headered CSV; shorter rows are skipped, a missing file is empty."""
    schema = f"`{names[0]}` string, `{names[1]}` string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return two_columns(csv(spark, path, schema), *names)


def two_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Columns a and b of rows that have both."""
    return df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())


def first_available(spark: SparkSession, candidates: list[tuple[str, str]], schema: str) -> DataFrame:
    """The first of (format, path) that exists; an empty table if none does."""
    for kind, path in candidates:
        if exists(spark, path):
            reader = spark.read.schema(schema)
            return reader.option("multiLine", True).json(path) if kind == "json" else reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    return spark.createDataFrame([], schema)


def with_freshness(df: DataFrame, hours: float = 24, now: datetime | None = None) -> DataFrame:
    """A file table with modified_at and is_stale; a stale row is still returned."""
    at = F.lit(now) if now else F.current_timestamp()
    modified = F.col("_metadata.file_modification_time")
    return df.select("*", modified.alias("modified_at"), (modified < at - F.expr(f"make_dt_interval(0, 0, {int(hours * 60)})")).alias("is_stale"))


def partition_of(df: DataFrame, column: str, value: str) -> DataFrame:
    """One category of a table; of one stored by folders of `column` (sinks.write_by, snapshots.publish) only its files are read."""
    return df.filter(F.col(column) == value)


def materialize(spark: SparkSession, build: Callable[[], DataFrame], path: str, hours: float = 24, force: bool = False) -> DataFrame | None:
    """The newest snapshot in the folder `path` if it is younger than `hours`; else one that is built and published beside the older ones.

    Readers planned on an older snapshot finish: its files stay for `hours` (a day at least) after it was replaced. If building fails or gives no row, a warning
    says so and the newest one is returned, however old; None if there is none."""
    done = snapshots.versions(spark, path)
    if done and not force and datetime.now(UTC) - done[-1].at < timedelta(hours=hours):
        return snapshots.read(spark, path)
    why = "it has no rows"
    try:
        if snapshots.publish(build(), path):
            snapshots.expire(spark, path, hours=max(hours, 24))
            return snapshots.read(spark, path)
    except Exception as e:  # whatever the build raises, the old table serves
        why = f"{type(e).__name__}: {e}"[:300]
    warnings.warn(f"{path} was not built again: {why}", stacklevel=2)
    return snapshots.read(spark, path)


def scratch(spark: SparkSession) -> str:
    """A new folder for a table that a query writes and reads again: under spark.checkpoint.dir, in local mode a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/quillcast-{uuid.uuid4().hex}"
