"""Column functions on values: coercion, defaults, dates, clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def to_number(c: Column) -> Column:
    """Text as a double; null where it isn't a plain decimal number."""
    c = c.cast("string")
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def safe_float(c: Column) -> Column:
    """to_number with 0 for null and bad text."""
    return F.coalesce(to_number(c), F.lit(0.0))


def first_present(df: DataFrame, names: list[str], default: float = 0.0) -> Column:
    """The first of the columns that df has, as a double (its nulls stay); the default if it has none."""
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`").cast("double")
    return F.lit(float(default))


def truthy(*cs: Column) -> Column:
    """The first operand that is neither null nor 0 nor ''; the last one as it is."""
    kept = [F.when(c.cast("string").isin("", "0", "0.0"), None).otherwise(c) for c in cs[:-1]]
    return F.coalesce(*kept, cs[-1])


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Within bounds; null stays null."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def parse_date(c: Column) -> Column:
    """A date from `Thu, Apr 9, 2026`, `Apr 09, 2026`, `2026-04-09` or `20260409`; null for other text."""
    bare = F.regexp_replace(c, "^[A-Za-z]{3}, ", "")
    tries = [F.try_to_timestamp(bare, F.lit(f)) for f in ("MMM d, yyyy", "yyyy-MM-dd", "yyyyMMdd")]
    return F.to_date(F.coalesce(*tries))


def unit_noise(seed: int | str, name: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed, a name and integer keys only, on no partitioning."""
    text = F.concat_ws(":", F.lit(f"{seed}:{name}"), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(low: float, high: float, seed: int | str, name: str, *keys: Column) -> Column:
    return F.lit(low) + F.lit(high - low) * unit_noise(seed, name, *keys)


def counter_noise(seed: int, stream: str, names: list[str], *keys: Column) -> dict[str, Column]:
    """For each name a number in [0, 1) of 2 ** 21 steps, like unit_noise(); three names share one 64-bit hash of the keys and a counter."""
    out = {}
    for k, name in enumerate(names):
        h = F.xxhash64(F.lit(f"{seed}:{stream}:{k // 3}"), *keys)
        out[name] = F.shiftrightunsigned(h, 21 * (k % 3)).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") / F.lit(float(1 << 21))
    return out


def noises(kind: str, bounds: dict[str, tuple[float, float]], seed: int, stream: str, *keys: Column) -> dict[str, Column]:
    """For each name a number within its bounds: by counter_noise() with kind "counter", by unit_noise() (digits of md5) with "md5"."""
    if kind == "md5":
        return {n: uniform(*b, seed, n, *keys) for n, b in bounds.items()}
    if kind != "counter":
        raise ValueError(f"unknown noise: {kind}")
    return {n: F.lit(bounds[n][0]) + F.lit(bounds[n][1] - bounds[n][0]) * u for n, u in counter_noise(seed, stream, list(bounds), *keys).items()}
