"""Writing tables: CSV, JSON, both, by partition, only if there are rows; run metadata; results as JSON."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_dual(df: DataFrame, base: str) -> None:
    """JSON and CSV side by side; an empty table writes empty outputs."""
    write_json(df, f"{base}.json")
    write_csv(df, f"{base}.csv")


def write_unless_empty(df: DataFrame | None, path: str) -> str | None:
    """Write Parquet and return the path; None, and nothing written, for no table or an empty one."""
    if df is None or df.isEmpty():
        return None
    df.write.mode("overwrite").parquet(path)
    return path


def write_by(df: DataFrame, column: str, path: str) -> None:
    """One folder for each value, none for values without rows."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def run_metadata(df: DataFrame, season: int, source: str) -> DataFrame:
    """One row: n_rows, season, source."""
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(season).alias("season"), F.lit(source).alias("source"))


def append_metadata(df: DataFrame, path: str, season: int, source: str, now: datetime | None = None) -> DataFrame:
    """Append run_metadata() of df with last_updated (`now`, else the time of the run) to the table at `path`; the row."""
    at = F.lit(now) if now else F.current_timestamp()
    row = run_metadata(df, season, source).select(at.alias("last_updated"), "*")
    row = df.sparkSession.createDataFrame(row.collect(), row.schema)  # one row; stored and returned alike
    row.write.mode("append").parquet(path)
    return row


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
