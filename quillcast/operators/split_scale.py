"""Exact shuffled splits and population scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_split(df: DataFrame, group: str, keys: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: exactly ceil(share * n) rows of each group of n, shuffled by a hash of `keys` and the seed."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    w = Window.partitionBy(group)
    ranked = df.withColumn("_n", F.row_number().over(w.orderBy(h, *keys))).withColumn("_all", F.count("*").over(w))
    return ranked.withColumn("is_test", F.col("_n") <= F.ceil(F.lit(share) * F.col("_all"))).drop("_n", "_all")


def test_copies(keys: list[str], n: int, share: float = 0.2, seed: int = 42) -> Column:
    """Of copies 0 to n - 1 of a row those that are its test rows: ceil(share * n) of them, in the order of a hash of keys, copy and seed. Known before the
    copies are made, so an exact split within each row's copies takes no window and no shuffle."""
    each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.struct(F.xxhash64(F.lit(seed), *keys, c).alias("h"), c.alias("c")))
    return F.slice(F.array_sort(each), 1, math.ceil(share * n))["c"]


def hash_cut(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = 42, few: int = 10_000) -> tuple[Column, int]:
    """(a 64-bit hash of the keys, the ceil(share * n)-th least hash of the n rows of df), by distributed selection.

    Rows are counted by the first 16 bits of the hash (at most 2 ** 16 numbers reach the driver), then those with the cut's bits
    by the next 16, until `few` hashes or fewer are left. Of df only the keys are read, and nothing is sorted."""
    h = F.xxhash64(F.lit(seed), *keys)
    rows, wanted, shift = df.select(h.alias("h")), None, 48
    while True:
        counts = sorted((r["b"], r["n"]) for r in rows.groupBy(F.shiftright("h", shift).alias("b")).agg(F.count("*").alias("n")).collect())
        if wanted is None:
            wanted = math.ceil(share * sum(n for _, n in counts))
        if not wanted:
            return h, -(1 << 63)
        for b, n in counts:
            if wanted <= n:
                break
            wanted -= n
        if wanted == n or not shift:
            return h, (b << shift) + (1 << shift) - 1
        rows = rows.filter(F.shiftright("h", shift) == b)
        if n <= few:
            return h, sorted(r["h"] for r in rows.collect())[wanted - 1]
        shift -= 16


def pooled_split(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: exactly ceil(share * n) of all n rows if the keys tell rows apart (rows with equal keys stay together), shuffled by
    a hash of the keys and the seed. Rows stay where they are: each compares its hash with one number."""
    h, cut = hash_cut(df, keys, share, seed)
    return df.withColumn("is_test", (h <= F.lit(cut)) & F.lit(cut > -(1 << 63)))


def moments(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Mean and population standard deviation of each column, as <column>_mean and <column>_std."""
    return df.groupBy(*by).agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def standardize(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """df with <column>_z, scaled within each group; a column without spread is only centred."""
    m = moments(df, columns, by)
    out = df.join(m, list(by))
    scale = lambda c: F.when(F.col(f"{c}_std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}_std"))
    return out.select(*df.columns, *(((F.col(c) - F.col(f"{c}_mean")) / scale(c)).alias(f"{c}_z") for c in columns))
