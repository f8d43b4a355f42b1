"""A log with rolling means that grows by batches: each batch is one snapshot version, which holds its rows, its late rows and the new state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from quillcast.operators import rolling
from quillcast.sources import snapshots


def _part(spark: SparkSession, path: str, versions: list[snapshots.Version], part: str) -> DataFrame | None:
    """One part of some versions; only its folders are read. None if there is none."""
    folders = [f"{path.rstrip('/')}/{v.folder}" for v in versions]
    fs, _ = snapshots._fs(spark, path)
    found = [f"{f}/part={part}" for f in folders if fs.exists(snapshots._fs(spark, f"{f}/part={part}")[1])]
    return spark.read.option("mergeSchema", True).parquet(*found) if found else None


def append(new: DataFrame, path: str, entity: str, order: list[str], columns: list[str], n: int = 5, now: datetime | None = None) -> snapshots.Version | None:
    """Add a batch to the log in the folder `path`; the new version, or None if there are no rows at all.

    Rows and state are published at once or not at all, so a batch whose writer died can be appended again; one that was published and comes again
    is late as a whole. One writer at a time: two that start from the same state would both be published."""
    spark = new.sparkSession
    state = _part(spark, path, snapshots.versions(spark, path)[-1:], rolling.STATE)
    return snapshots.publish(rolling.rolling_step(state, new, entity, order, columns, n), path, by=("part",), now=now)


def rows(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the log with their means; None without any."""
    return _part(spark, path, snapshots.versions(spark, path), rolling.ROWS)


def late(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that came too late for the log; None without any."""
    return _part(spark, path, snapshots.versions(spark, path), rolling.LATE)


def state(spark: SparkSession, path: str) -> DataFrame | None:
    """The last n rows of each entity; None before the first batch."""
    return _part(spark, path, snapshots.versions(spark, path)[-1:], rolling.STATE)


def expire_states(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove the states of all but the newest `keep` versions, whose rows stay; how many there were."""
    gone = 0
    for v in snapshots.versions(spark, path)[: -max(keep, 1)]:
        fs, p = snapshots._fs(spark, f"{path.rstrip('/')}/{v.folder}/part={rolling.STATE}")
        gone += bool(fs.exists(p) and fs.delete(p, True))
    return gone
