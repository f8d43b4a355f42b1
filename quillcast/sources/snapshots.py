"""Tables as snapshots: each build is a folder of its own, and a small version file, created at once or not at all, says which one counts.

Readers plan on the files of the version that they found and may go on while newer ones are published; a build's files go only when its
version has been replaced for longer than the retention. Writers that meet take different version numbers. Version files are created without
overwriting, which the file system does atomically; one that isn't complete (its writer died) doesn't count.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

VERSIONS = "_versions"


@dataclass(frozen=True)
class Version:
    """A version's number, the folder of its build, when it was published, and the columns that its folders stand for."""

    number: int
    folder: str
    at: datetime
    by: tuple[str, ...]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All published versions, the newest last."""
    fs, p = _fs(spark, f"{path.rstrip('/')}/{VERSIONS}")
    out = []
    for s in fs.listStatus(p) if fs.exists(p) else []:
        stream = fs.open(s.getPath())
        try:
            v = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            out.append(Version(v["number"], v["folder"], datetime.fromisoformat(v["at"]), tuple(v["by"])))
        except ValueError:  # not complete
            continue
        finally:
            stream.close()
    return sorted(out, key=lambda v: v.number)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The newest version of the table, or the one of that number; None without one."""
    found = [v for v in versions(spark, path) if number in (None, v.number)]
    return spark.read.parquet(f"{path.rstrip('/')}/{found[-1].folder}") if found else None


def publish(df: DataFrame, path: str, by: tuple[str, ...] = (), now: datetime | None = None) -> Version | None:
    """Write df as a new build, in folders of the columns `by`, and make it the newest version; None, and no version, if it has no rows."""
    spark, root = df.sparkSession, path.rstrip("/")
    now = now or datetime.now(UTC)
    folder = f"built={now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    fs, build = _fs(spark, f"{root}/{folder}")
    try:
        df.write.partitionBy(*by).parquet(f"{root}/{folder}")
        if spark.read.schema(df.schema).parquet(f"{root}/{folder}").isEmpty():
            fs.delete(build, True)
            return None
    except Exception:
        fs.delete(build, True)
        raise
    number = max((v.number for v in versions(spark, path)), default=0)
    while True:
        number += 1
        version = Version(number, folder, now, by)
        try:
            stream = fs.create(_fs(spark, f"{root}/{VERSIONS}/{number:012d}.json")[1], False)
        except Exception:  # another writer has this number
            if not fs.exists(_fs(spark, f"{root}/{VERSIONS}/{number:012d}.json")[1]):
                raise
            continue
        stream.write(bytearray(json.dumps({"number": number, "folder": folder, "at": now.isoformat(), "by": list(by)}).encode()))
        stream.close()
        return version


def expire(spark: SparkSession, path: str, keep: int = 2, hours: float = 24, now: datetime | None = None) -> list[int]:
    """Remove versions that were replaced more than `hours` ago, but for the newest `keep`, with their files; the numbers removed."""
    every, root, gone = versions(spark, path), path.rstrip("/"), []
    limit = (now or datetime.now(UTC)) - timedelta(hours=hours)
    for v, after in zip(every, every[1:]):
        if after.at < limit and v.number <= every[-1].number - keep:
            fs, p = _fs(spark, f"{root}/{VERSIONS}/{v.number:012d}.json")
            fs.delete(p, False)  # the version first: no reader finds it any more
            fs.delete(_fs(spark, f"{root}/{v.folder}")[1], True)
            gone.append(v.number)
    return gone
