"""Synthetic training rows: replicas of a feature row with repeatable noise, and targets by formula."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.functions.values import clamp, noises

#: The columns of a feature row, with the defaults of a training base row.
NUMERIC = ["pts", "reb", "ast", "mins", "fga", "fg3a", "fta", "stl", "blk", "tov"]
CONTEXT = ["usage_rate", "is_home", "spread", "total", "opp_pts_allowed", "opp_reb_allowed", "opp_ast_allowed", "opp_fd_allowed"]
FEATURES = NUMERIC + CONTEXT
DEFAULTS = {"pts": 20.0, "reb": 8.0, "ast": 6.0, "mins": 32.0, "fga": 15.0, "fg3a": 5.0, "fta": 6.0, "stl": 1.2, "blk": 0.8, "tov": 2.5}
#: Bounds of the noise on a feature, on a target's rate, and on a target at its end.
NOISE, RATE, FINAL = (0.8, 1.2), (0.9, 1.1), (0.95, 1.05)
HOME, AWAY = 1.05, 0.98


def replicate(df: DataFrame, keys: list[str], columns: list[str], n: int = 100, seed: int = 42, noise: str = "md5") -> DataFrame:
    """n copies of each row, numbered by `copy`, each of `columns` times its own noise; the rest stays as it is.

    Noise depends on keys, copy, column and seed only (see noises() for its kinds). Copies are made by explode, in the task of the row."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ks = [F.col(k) for k in keys] + [F.col("copy")]
    u = noises(noise, {c: NOISE for c in columns}, seed, "copies", *ks)
    return out.select(*((F.col(c) * u[c]).alias(c) if c in columns else F.col(c) for c in out.columns))


def targets(df: DataFrame, keys: list[str], seed: int = 42, noise: str = "md5") -> DataFrame:
    """df with target_pts, target_reb, target_ast (each at least 0) and target_fd, the weighted score of the unfloored values."""
    ks = [F.col(k) for k in keys]
    u = noises(noise, {f"t_{k}": RATE for k in ("pts", "reb", "ast")} | {f"f_{k}": FINAL for k in ("pts", "reb", "ast")}, seed, "targets", *ks)
    home = F.when(F.col("is_home") == 1, HOME).otherwise(AWAY)
    raw = {
        "pts": F.col("pts") * u["t_pts"] * (F.col("usage_rate") / 25) * (F.col("opp_pts_allowed") / 25) * home * (F.col("total") / 220) * u["f_pts"],
        "reb": F.col("reb") * u["t_reb"] * (F.col("opp_reb_allowed") / 8) * home * u["f_reb"],
        "ast": F.col("ast") * u["t_ast"] * (F.col("usage_rate") / 25) * (F.col("opp_ast_allowed") / 6) * home * u["f_ast"],
    }
    df = df.withColumns({f"_{k}": v for k, v in raw.items()})
    score = weighted_score(F.col("_pts"), F.col("_reb"), F.col("_ast"), F.col("stl"), F.col("blk"), F.col("tov"))
    out = df.withColumns({f"target_{k}": clamp(F.col(f"_{k}"), 0.0) for k in raw} | {"target_fd": score})
    return out.drop(*(f"_{k}" for k in raw))


def weighted_score(pts, reb, ast, stl, blk, tov):
    """pts + 1.2 reb + 1.5 ast + 3 stl + 3 blk - tov, at least 0."""
    return clamp(pts + 1.2 * reb + 1.5 * ast + 3.0 * stl + 3.0 * blk - tov, 0.0)
