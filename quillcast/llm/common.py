"""What the operators share: reading tables, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java and RE2 character class body.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"


#: Bits of a sieve, at any number of documents.
SIEVE = 1 << 27
#: Folders of our own, by application.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode one of our own where that is unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or _OWN.get(sc.applicationId)
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return root.rstrip("/")


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to a new table in the shared folder and read it from there: lineage is cut, every
    executor can read the files, and a lost executor costs no recomputation. Removed at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillcast-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """What is written inside reaches Python workers in batches of at most so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def discard(df: DataFrame) -> None:
    """Remove the files of a table that keep() stored and that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(part, bits): bitmaps of 4 KB of the hashes of a column, at most SIEVE bits in all."""
    h = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    return keys.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))


def sifted(rows: DataFrame, bits: DataFrame, key: str) -> DataFrame:
    """The rows whose bit is set: all that are wanted, and few others until the sieve fills up. bits is broadcast: 16 MB at most."""
    rows = rows.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(SIEVE)))
    rows = rows.withColumn("_part", F.bitmap_bucket_number("_h")).withColumn("_bit", F.bitmap_bit_position("_h").cast("int"))
    rows = rows.join(F.broadcast(bits), F.col("_part") == F.col("part"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return rows.filter((F.floor(byte / F.pow(F.lit(2), F.col("_bit") % 8)) % 2) == 1).drop("_h", "_part", "_bit", "part", "bits")


def let(value, body):
    """Evaluate the column `value` once per row and use it in `body(column)`; a plain reference inside
    a higher-order function would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(df: DataFrame, by: list[str], bucket: str, *amounts: str) -> DataFrame:
    """Sums of `amounts` over all earlier buckets of the same group, one row per (group, bucket).

    The bucket number is bounded by its maker, so a window over one group reads a bounded number of rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, bucket).agg(*(F.sum(a).alias(a) for a in amounts))
    return sums.select(*by, bucket, *(F.coalesce(F.sum(a).over(w), F.lit(0)).alias(f"before_{a}") for a in amounts))
