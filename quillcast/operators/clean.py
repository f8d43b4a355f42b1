"""Cleaning tables: headers, repeated header rows, nulls, duplicates by a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcast.functions.values import to_number


def clean_header(df: DataFrame, prefix: str = "Sort: ") -> DataFrame:
    """Column names without a prefix and without the upper levels of `level|name`."""
    return df.toDF(*(c.split("|")[-1].removeprefix(prefix) for c in df.columns))


def drop_header_rows(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Without rows that repeat the header (the column holds its own name); nulls stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(name or column)))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Without these columns, whether or not they are there."""
    return df.drop(*names)


def coerce_except(df: DataFrame, *text: str) -> DataFrame:
    """Every column but `text` as a number."""
    return df.select(*(F.col(c) if c in text else to_number(F.col(c)).alias(c) for c in df.columns))


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in `order`, which must be total for a repeatable result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key in `order`, by a partial aggregate (no sort of the whole group)."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def split_valid(df: DataFrame, text: list[str], present: list[str]) -> DataFrame:
    """df with is_valid and reason: `text` columns must hold a character, `present` ones a value (0 counts)."""
    reasons = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"no {c}")) for c in text]
    reasons += [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in present]
    return df.withColumn("reason", F.coalesce(*reasons)).withColumn("is_valid", F.col("reason").isNull())


def group_summary(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """Per key its row count and its first n rows in `order`."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).filter(F.col("rank") <= n)
    return ranked.join(df.groupBy(key).agg(F.count("*").alias("n_rows")), key)
