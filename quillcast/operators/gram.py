"""Sums of products in blocks: partial matrices in numpy by Arrow batch, merged by tasks and not by rows.

A block is (rows, means, products of the deviations from the means); merging two blocks is exact up to rounding and loses no digits to
large means (Chan, Golub and LeVeque 1983). linear and bayesian models of all rows, and of each entity, come from these alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks that are merged at a time, entities that a task holds before it hands their blocks on.
FAN_IN, HELD = 32, 20_000
Block = tuple[int, np.ndarray, np.ndarray]


def block(z: np.ndarray) -> Block:
    mean = z.mean(axis=0)
    d = z - mean
    return len(z), mean, d.T @ d


def merge(a: Block | None, b: Block) -> Block:
    if a is None:
        return b
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def packed(columns: list[str]) -> Column:
    """The columns as one array of doubles, `z`: an array goes to Python in less than half the time of as many columns."""
    return F.array(*(F.col(c).cast("double") for c in columns)).alias("z")


def matrix(arrays: pa.Array) -> np.ndarray:
    """Arrays of one length as rows of doubles; a null is NaN."""
    values = arrays.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return values.reshape(len(arrays), -1 if len(arrays) else 0)


def _pack(b: Block) -> bytes:
    return np.concatenate([[b[0]], b[1], b[2].reshape(-1)]).tobytes()


def _unpack(v: bytes) -> Block:
    x = np.frombuffer(v)
    m = int((np.sqrt(4 * len(x) - 3) - 1) / 2)
    return int(x[0]), x[1 : m + 1], x[m + 1 :].reshape(m, m)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = None
    for batch in batches:
        z = matrix(batch.column(0))
        z = z[np.isfinite(z).all(axis=1)]
        if len(z):
            own = merge(own, block(z))
    if own:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([_pack(own)], pa.binary())], names=["part", "block"])


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    total = None
    for v in rows.sort_by("part").column("block").to_pylist():
        total = merge(total, _unpack(v))
    return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([_pack(total)], pa.binary())], names=["part", "block"])


def gram(df: DataFrame, columns: list[str]) -> Block | None:
    """The block of all rows of df in which every column is a number; None without any. At most FAN_IN blocks reach the driver."""
    rows = df.select(packed(columns))
    parts, n = rows.mapInArrow(_partial, "part long, block binary"), rows.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.groupBy((F.col("part") % n).alias("_to")).applyInArrow(_merged, "part long, block binary")
    total = None
    for r in sorted(parts.collect()):
        total = merge(total, _unpack(r["block"]))
    return total


def _by_entity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([_pack(b) for b in held.values()], pa.binary())], names=["entity", "block"])
        held.clear()
        return out

    for batch in batches:
        kind = batch.column(0).type
        z = matrix(batch.column(1))
        ok = np.isfinite(z).all(axis=1)
        names = batch.column(0).filter(pa.array(ok)).dictionary_encode("encode")
        z, at = z[ok], names.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(at[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        for e, rows in zip(names.dictionary.take(pa.array(at[order][cuts])).to_pylist(), np.split(order, cuts[1:])):
            held[e] = merge(held.get(e), block(z[rows]))
        if len(held) > HELD:
            yield flush()
    if held:
        yield flush()


def gram_by(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """(entity, blocks): what tasks found for each entity, one block for each task that has rows of it."""
    rows = df.select(F.col(entity).alias("entity"), packed(columns))
    kind = rows.schema["entity"].dataType.simpleString()
    return rows.mapInArrow(_by_entity, f"entity {kind}, block binary").groupBy("entity").agg(F.sort_array(F.collect_list("block")).alias("blocks"))


def total(blocks: list[bytes]) -> Block:
    out = None
    for b in blocks:
        out = merge(out, _unpack(b))
    return out


def least_squares(b: Block) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the last column on the others, of least norm on scaled columns. Columns that don't vary have 0."""
    _, mean, c = b
    n = max(b[0], 1)
    scale = np.sqrt(np.maximum(np.diag(c)[:-1] / n, 0))
    own = np.flatnonzero(scale > 1e-9 * (1 + np.abs(mean[:-1])))
    w = np.zeros(len(mean) - 1)
    if len(own):
        s = scale[own]
        w[own] = np.linalg.lstsq(c[np.ix_(own, own)] / np.outer(s, s) / n, c[own, -1] / s / n, rcond=1e-10)[0] / s
    return w, float(mean[-1] - w @ mean[:-1])


def evidence_ridge(b: Block, rounds: int = 300, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of ridge regression on standard-scaled columns, with noise and weight precisions from the evidence (MacKay 1992)."""
    n, mean, c = b
    scale = np.sqrt(np.maximum(np.diag(c)[:-1] / n, 0))
    scale[scale <= 1e-9 * (1 + np.abs(mean[:-1]))] = np.inf  # a column that doesn't vary has no part
    xx, xy, yy = c[:-1, :-1] / np.outer(scale, scale), c[:-1, -1] / scale, c[-1, -1]
    values, vectors = np.linalg.eigh(xx)
    values, turned = np.maximum(values, 0), vectors.T @ xy
    alpha, lam, w = n / max(yy, 1e-12), 1.0, np.zeros(len(xy))
    for _ in range(rounds):
        new = vectors @ (turned / (values + lam / alpha))
        gamma = float((alpha * values / (lam + alpha * values)).sum())
        residual = max(yy - 2 * new @ xy + new @ xx @ new, 1e-12)
        lam, alpha = (gamma + 2e-6) / (new @ new + 2e-6), (n - gamma + 2e-6) / (residual + 2e-6)
        done = np.abs(new - w).sum() < tolerance
        w = new
        if done:
            break
    w = w / scale
    return w, float(mean[-1] - w @ mean[:-1])
