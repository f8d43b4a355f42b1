"""Histogram trees: boosted ones, level-wise and leaf-wise, and forests, over features in bins.

Bins come from a sketch: counts of cells of bounded relative width above each feature's least value. Counts are added up, so bins don't depend on partitions.
A boosted model is one barrier job: each task takes its share of the binned rows (two bytes for each pair of features) and keeps it through all trees; for each level of a tree the
tasks exchange histograms by allGather, which takes a second a call, and choose the same splits; up to LEAST_ROWS rows are one task's, which exchanges nothing.
A row's gradient and the row itself are added up in one number. Of two sister nodes the smaller one is counted, the other is what is left of their parent. Gradients are whole numbers of a fixed unit, so sums are exact
and a boosted model is the same under any partitioning. Tables beyond TASKS * TASK_ROWS rows, which no barrier stage can hold, are grown by one job for each level
instead, with the same result. A forest's trees all grow in step, by one job for each level.
"""

from __future__ import annotations

import base64
import pickle
import zlib
from collections.abc import Callable, Generator, Iterator
from contextvars import ContextVar
from functools import lru_cache
from threading import Lock

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.operators import gram

TREES = 50
#: Tasks of a barrier job, rows that one holds (28 bytes each at 18 features), and rows below which a task alone is quicker than the five minutes of messages of several.
TASKS, TASK_ROWS, LEAST_ROWS = 16, 42_000_000, 32_000_000
#: Rows that are handled together, and bytes of one exchange of all tasks.
BLOCK, MESSAGES = 1 << 16, 64 << 20
#: Rows of a forest in one task.
FOREST_ROWS = 4_000_000
#: Models that are fitted side by side; each takes its share of the slots.
BESIDE: ContextVar[int] = ContextVar("beside", default=1)
#: Bits of a packed sum that count rows; the others, but for the sign, hold the sum of gradients.
COUNT = 18
#: Partial sums that reach the driver at a time; trees after which a row's margin is stored again (one job for each level only).
FAN_IN, RENEW = 32, 5
#: Bits of a cell: sign and exponent, and so many of the mantissa.
MANTISSA = 11
Scorer = Callable[[DataFrame], DataFrame]
Tree = list[tuple]


def cells(x: np.ndarray) -> np.ndarray:
    """The cell of each number that isn't negative; cells increase with the numbers."""
    return np.ascontiguousarray(x, dtype=np.float64).view(np.int64) >> (52 - MANTISSA)


def cell_end(cell: np.ndarray) -> np.ndarray:
    """The largest number of each cell."""
    return (((np.asarray(cell, np.int64) + 1) << (52 - MANTISSA)) - 1).view(np.float64)


def _counted(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different cells in their order and how often each is there; cells that lie close are counted without being sorted."""
    low, high = (int(cell.min()), int(cell.max())) if len(cell) else (0, -1)
    if high - low >= 8 * len(cell) + 1024 or not len(cell):
        return np.unique(cell, return_counts=True)
    n = np.bincount(cell - low)
    found = np.flatnonzero(n)
    return found + low, n[found]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Matrices of BLOCK rows or more, so that what is found in them is merged less often; their columns are from gram.packed()."""
    held: list[np.ndarray] = []
    for p in batches:
        held.append(gram.matrix(p.column(0)))
        if sum(map(len, held)) >= BLOCK:
            yield held
            held = []
    if held:
        yield held


def bin_edges(df: DataFrame, features: list[str], bins: int = 32, least: list[float] | None = None) -> list[list[float]]:
    """Inner bounds of each feature's bins: quantiles to within a cell, the same under any partitioning. Nulls and NaN don't count."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in features))
    low = least or [v if v is not None else 0.0 for v in rows.agg(*(F.min(F.when(~F.isnan(c), F.col(c))).alias(c) for c in features)).first()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
        for z in _together(batches):
            for k, a in enumerate(low):
                x = np.concatenate([b[:, k] for b in z])
                found, n = _counted(cells(np.abs(x[~np.isnan(x)] - a)))
                every, at = np.unique(np.concatenate([own[k][0], found]), return_inverse=True)
                own[k] = every, np.bincount(at, np.concatenate([own[k][1], n]), len(every)).astype(np.int64)
        for k, (c, n) in enumerate(own):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k)), pa.array(c), pa.array(n)], names=["f", "cell", "n"])

    found = rows.select(gram.packed(features)).mapInArrow(count, "f long, cell long, n long").groupBy("f", "cell").agg(F.sum("n").alias("n")).toArrow().sort_by([("f", "ascending"), ("cell", "ascending")])
    f, cell, n = (found.column(c).to_numpy() for c in ("f", "cell", "n"))
    out = []
    for k, a in enumerate(low):
        own = f == k
        upto = np.cumsum(n[own])
        if not len(upto):
            out.append([])
            continue
        at = np.searchsorted(upto, np.arange(1, bins) * upto[-1] / bins, "left")
        out.append(sorted({float(v) for v in a + cell_end(cell[own][at])}))
    return out


def best_split(sums: np.ndarray, lam: float, least: int) -> tuple[float, int, int]:
    """The best split of a node from sums[feature, bin, (g, h)]: gain, feature, last bin on the left."""
    g, h = sums[:, :, 0], sums[:, :, 1]
    gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    ga, ha = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):  # without lam an empty side divides by 0; such splits don't count
        gain = gl**2 / (hl + lam) + (ga - gl) ** 2 / (ha - hl + lam) - ga**2 / (ha + lam)
    gain[(hl < least) | (ha - hl < least)] = -np.inf
    if not gain.size or not np.isfinite(gain.max()):
        return 0.0, -1, -1
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of binned features. A node is (feature, bin, low, high, value); feature -1 is a leaf, whose value counts."""
    f, b, low, high = (np.array([n[k] for n in tree]) for k in range(4))
    at, rows = np.zeros(len(x), int), np.arange(len(x))
    while True:
        inner = f[at] >= 0
        if not inner.any():
            return at
        at = np.where(inner, np.where(x[rows, f[at]] <= b[at], low[at], high[at]), at)


def values(tree: Tree) -> np.ndarray:
    return np.array([n[4] for n in tree])


def best_first(tree: Tree, gains: dict[int, float], leaves: int) -> set[int]:
    """The nodes of a fully grown tree that leaf-wise growth splits: always the waiting leaf of most gain, up to `leaves` leaves."""
    taken: set[int] = set()
    waiting = [0] if 0 in gains else []
    while waiting and len(taken) < leaves - 1:
        node = max(waiting, key=lambda k: (gains[k], -k))
        waiting.remove(node)
        taken.add(node)
        waiting += [k for k in tree[node][2:4] if k in gains]
    return taken


def pruned(tree: Tree, taken: set[int]) -> tuple[Tree, np.ndarray]:
    """The part of a tree that splits only the nodes `taken`, and what it gives the rows at each node of the whole one."""
    kept = sorted({0} | {k for n in taken for k in tree[n][2:4]})
    new, gives = {k: i for i, k in enumerate(kept)}, values(tree)
    for k, n in enumerate(tree):  # a node stands behind its parent
        for child in n[2:4] if n[0] >= 0 and k not in taken else ():
            gives[child] = gives[k]
    return [(f, b, new[low], new[high], v) if k in taken else (-1, 0, 0, 0, v) for k in kept for f, b, low, high, v in [tree[k]]], gives


#: Of a node's best split: gain, feature, last bin on the left, and (g, h) on the left and on the right.
Choice = tuple[float, int, int, tuple[int, int], tuple[int, int]]
NONE: Choice = (0.0, -1, -1, (0, 0), (0, 0))


def chosen(s: np.ndarray, lam: float, least: int) -> Choice:
    """The choice of a node with the whole-number sums[feature, bin, (g, h)]."""
    gain, f, b = best_split(s.astype(float), lam, least)
    if gain <= 1e-12:
        return NONE
    return gain, f, b, tuple(s[f, : b + 1].sum(0).tolist()), tuple(s[f, b + 1 :].sum(0).tolist())


def deciding(depth: int, lam: float, least: int) -> Generator[tuple[Tree, list[tuple[int, int, int]]], dict[int, Choice], tuple[Tree, dict[int, float]]]:
    """Grows a tree, level by level: yields (tree, families) to be sent the choices of the families' nodes; returns the tree and its splits' gains.

    A family is (parent, the child with fewer rows, the other one), or (-1, 0, 0) for the root. A node's best split doesn't depend on other nodes, so leaf-wise growth takes no more levels."""
    tree: Tree = [(-1, 0, 0, 0, 0.0)]
    gains: dict[int, float] = {}
    families = [(-1, 0, 0)]
    for _ in range(depth):
        if not families:
            break
        found = yield tree, families
        families = []
        for node in sorted(found):
            gain, f, b, low, high = found[node]
            if f >= 0:
                at = len(tree)
                tree += [(-1, 0, 0, 0, -float(low[0]) / (float(low[1]) + lam)), (-1, 0, 0, 0, -float(high[0]) / (float(high[1]) + lam))]
                tree[node] = (f, b, at, at + 1, tree[node][4])
                gains[node] = gain
                if max(low[1], high[1]) >= 2 * least:
                    families.append((node, at, at + 1) if low[1] <= high[1] else (node, at + 1, at))
    return tree, gains


def with_sisters(found: dict[int, np.ndarray], families: list[tuple[int, int, int]], parents: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The sums of all nodes of the families, from those of the smaller sisters and of the parents."""
    return found | {large: parents[parent] - found[small] for parent, small, large in families if parent >= 0}


def growing(depth: int, lam: float, least: int) -> Generator[tuple[Tree, list[int]], dict[int, np.ndarray], tuple[Tree, dict[int, float]]]:
    """deciding(), with sums in place of choices: yields (tree, nodes) to be sent the sums[feature, bin, (g, h)] of these nodes, the root and of each two sisters the smaller one."""
    step, held = deciding(depth, lam, least), {}
    try:
        tree, families = next(step)
        while True:
            held = with_sisters(dict((yield tree, [small for _, small, _ in families])), families, held)
            tree, families = step.send({n: chosen(s, lam, least) for n, s in held.items()})
    except StopIteration as e:
        return e.value


def grow_tree(sums_of: Callable[[Tree, list[int]], dict[int, np.ndarray]], growth: str, depth: int, leaves: int, lam: float, least: int) -> tuple[Tree, Tree, np.ndarray]:
    """(the tree, the whole one that it is a part of, what the tree gives the rows at each node of the whole one). sums_of(tree, nodes) gives the sums of each node."""
    step = growing(depth, lam, least)
    try:
        asked = next(step)
        while True:
            asked = step.send(sums_of(*asked))
    except StopIteration as e:
        tree, gains = e.value
    return (lambda part, gives: (part, tree, gives))(*pruned(tree, best_first(tree, gains, leaves) if growth == "leaf" else set(gains)))


class Settings:
    """How trees are grown, and what a table says of its label: base (its mean without the digits that depend on the order of a sum) and unit (2 ** -30 of the largest deviation)."""

    def __init__(self, growth: str, trees: int, depth: int, leaves: int, rate: float, lam: float):
        self.growth, self.trees, self.depth, self.leaves, self.rate, self.lam = growth, trees, depth, leaves, rate, lam
        self.least = 20 if growth == "leaf" else 1
        self.base, self.unit, self.wide, self.k = 0.0, 1.0, 1, 0


def _binned(edges: list[list[float]], s: Settings):
    """Some BLOCK rows of packed features and label as one row: x (bytes, row by row) and y, the label's deviation in units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for z in _together(batches):
            x = np.empty((sum(map(len, z)), len(edges)), np.uint8)
            for i, e in enumerate(edges):
                v = np.concatenate([b[:, i] for b in z])
                v[np.isnan(v)] = -np.inf
                x[:, i] = np.searchsorted(e, v, "left")
            y = (np.concatenate([b[:, -1] for b in z]) - s.base) / s.unit
            if len(y):
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y)], names=["x", "y"])

    return run


def _rows(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = (b"".join(batch.column(c).to_pylist()) for c in (0, 1))
    return np.frombuffer(x, np.uint8).reshape(-1, k), np.frombuffer(y)


@lru_cache(4)
def _numbers(n: int) -> np.ndarray:
    return np.arange(n)


class _Block:
    """Binned rows: of each two features one code, so that one count serves both."""

    def __init__(self, x: np.ndarray, y: np.ndarray, wide: int):
        x = np.ascontiguousarray(x.T)
        if len(x) % 2:
            x = np.concatenate([x, np.zeros((1, x.shape[1]), np.uint8)])
        self.pairs = x[::2].astype(np.uint16 if wide <= 256 else np.uint32) * wide + x[1::2]
        self.y, self.wide, self.at, self.numbers = y, wide, np.zeros(len(y), np.int16), _numbers(len(y))

    def __len__(self) -> int:
        return len(self.y)

    def moved(self, at: np.ndarray, steps: tuple[np.ndarray, np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
        """The nodes of rows (else of all) that stand at the nodes `at`, one level further down."""
        pair, to = steps
        node = at.astype(np.int64)
        where = pair.take(node)
        where *= len(self)
        where += self.numbers if rows is None else rows
        code = self.pairs.reshape(-1).take(where)
        node *= to.shape[1]
        node += code
        return to.reshape(-1).take(node)

    def below_root(self, steps: tuple[np.ndarray, np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
        """The same where all stand at the root, and so look at the same features."""
        codes = self.pairs[steps[0][0]]
        return steps[1][0].take(codes if rows is None else codes.take(rows))


class _Sums:
    """Sums of gradients and of rows by pair of features, node and code.

    A cell is one whole number, gradients * 2 ** COUNT + rows, so that a row is added once for both; before one of them could outgrow its bits the cells are taken apart."""

    def __init__(self, pairs: int, nodes: int, wide: int):
        self.total, self.wide = np.zeros((2, pairs, nodes, wide**2), np.int64), wide
        self.cells = np.zeros((pairs, nodes * wide**2), np.int64)
        self.rows, self.most = 0, 0.0

    def add(self, b: _Block, own: np.ndarray, place: np.ndarray, g: np.ndarray, w: np.ndarray | None = None) -> None:
        """Add the rows with the numbers `own`, each at its place; w are weights, else 1."""
        rows, most = len(own) if w is None else int(w.sum()), float(np.abs(g).sum())
        if len(own) > 1 and (rows >= 1 << COUNT or most >= 1 << (62 - COUNT)):
            half = len(own) // 2
            for part in (slice(half), slice(half, None)):
                self.add(b, own[part], place[part], g[part], None if w is None else w[part])
            return
        if self.rows + rows >= 1 << COUNT or self.most + most >= 1 << (62 - COUNT):
            self.apart()
        self.rows, self.most = self.rows + rows, self.most + most
        value = g.astype(np.int64)
        value <<= COUNT
        value += 1 if w is None else w.astype(np.int64)
        key = place.astype(np.int64) * self.wide**2
        for cells, codes in zip(self.cells, b.pairs):
            np.add.at(cells, codes.take(own) + key, value)

    def apart(self) -> np.ndarray:
        cells = self.cells.reshape(self.total.shape[1:])
        self.total[0] += cells >> COUNT
        self.total[1] += cells & ((1 << COUNT) - 1)
        self.cells[:], self.rows, self.most = 0, 0, 0.0
        return self.total


def _places(tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each node of the tree is one of `nodes`, and which."""
    asked, place = np.zeros(len(tree), bool), np.zeros(len(tree), np.int64)
    asked[nodes], place[nodes] = True, np.arange(len(nodes))
    return asked, place


def _steps(tree: Tree, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pair of features each node looks at, and to which node a row with a code goes from there; rows at a leaf stay."""
    to = np.repeat(np.arange(len(tree), dtype=np.int16)[:, None], wide**2, axis=1)
    code = np.arange(wide**2)
    for k, (f, b, low, high, _) in enumerate(tree):
        if f >= 0:
            to[k] = np.where((code % wide if f % 2 else code // wide) <= b, low, high)
    return np.array([max(n[0], 0) // 2 for n in tree], np.int64), to


def _standing(b: _Block, steps: tuple[np.ndarray, np.ndarray], depth: int, rows: np.ndarray | None = None) -> np.ndarray:
    """The leaves of rows (else of all) in a tree of that depth."""
    if not depth:
        return np.zeros(len(b) if rows is None else len(rows), np.int16)
    at = b.below_root(steps, rows)
    for _ in range(depth - 1):
        at = b.moved(at, steps, rows)
    return at


def _by_feature(total: np.ndarray, k: int, wide: int) -> np.ndarray:
    """sums[node, feature, bin, (g, h)] from totals by pairs."""
    both = total.reshape(*total.shape[:3], wide, wide)
    out = np.stack([both.sum(4), both.sum(3)], axis=2)  # (g, h), pair, which, node, bin
    return np.ascontiguousarray(np.moveaxis(out.reshape(2, -1, *out.shape[3:])[:, :k], (0, 1, 2, 3), (3, 1, 0, 2)))


def _blocks(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[_Block]:
    for p in batches:
        for k in range(len(p)):
            yield _Block(*_rows(p.slice(k, 1), s.k), s.wide)


class _Held:
    """A task's binned rows, with the node where each stands in the tree that grows."""

    def __init__(self, batches: Iterator[pa.RecordBatch], s: Settings):
        self.s, self.blocks = s, list(_blocks(batches, s))
        self.all: np.ndarray | None = None

    def root(self) -> np.ndarray:
        """Sums at the root. Rows by pair and code are the same for all trees."""
        total = np.zeros((2, -(-self.s.k // 2), 1, self.s.wide**2), np.int64)
        if self.all is None:
            self.all = np.zeros(total.shape[1:], np.int64)
            for b in self.blocks:
                for p, codes in enumerate(b.pairs):
                    self.all[p, 0] += np.bincount(codes, minlength=self.s.wide**2)
        for b in self.blocks:
            g = np.rint(-b.y)
            for p, codes in enumerate(b.pairs):
                total[0, p, 0] += np.bincount(codes, g, self.s.wide**2).astype(np.int64)
        total[1] = self.all
        return total

    def sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        if len(tree) == 1:
            return _by_feature(self.root(), self.s.k, self.s.wide)
        steps, (asked, place) = _steps(tree, self.s.wide), _places(tree, nodes)
        found = _Sums(-(-self.s.k // 2), len(nodes), self.s.wide)
        for b in self.blocks:
            b.at = b.below_root(steps) if len(tree) == 3 else b.moved(b.at, steps)
            own = np.flatnonzero(asked.take(b.at))
            found.add(b, own, place.take(b.at.take(own)), np.rint(-b.y.take(own)))
        return _by_feature(found.apart(), self.s.k, self.s.wide)

    def take(self, tree: Tree, gives: np.ndarray) -> None:
        """Take off the rows what a tree gives them at the nodes of the whole one, and begin the next one."""
        steps, off = _steps(tree, self.s.wide), self.s.rate * gives
        for b in self.blocks:
            # All splits but those of the last level have been taken.
            b.y = b.y - off.take(b.moved(b.at, steps))
            b.at = np.zeros(len(b), np.int16)


def _barrier(s: Settings):
    """All tasks grow the same trees: for each level they send each other their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks = BarrierTaskContext.get()
        held, alone = _Held(batches, s), len(tasks.getTaskInfos()) == 1

        def sums_of(tree: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
            total = held.sums(tree, nodes)
            if not alone:
                every = tasks.allGather(base64.b64encode(total.tobytes()).decode())
                total = sum(np.frombuffer(base64.b64decode(m), np.int64) for m in every).reshape(total.shape)
            return dict(zip(nodes, total))

        forest: list[Tree] = []
        for _ in range(s.trees):
            tree, whole, gives = grow_tree(sums_of, s.growth, s.depth, s.leaves, s.lam, s.least)
            forest.append(tree)
            held.take(whole, gives)
        if tasks.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(forest)], pa.binary())], names=["model"])

    return run


def _by_levels(data: DataFrame, s: Settings) -> list[Tree]:
    """The same trees with a job for each level: rows stay on the executors, sums by node, feature and bin reach the driver."""
    n_parts = data.rdd.getNumPartitions()
    first = data = data.persist()

    def less(p: pa.RecordBatch, done: list[Tree]) -> Iterator[tuple[np.ndarray, _Block]]:
        ways = [(_steps(t, s.wide), _depth(t), s.rate * values(t)) for t in done]
        for k in range(len(p)):
            x, y = _rows(p.slice(k, 1), s.k)
            b = _Block(x, y, s.wide)
            for steps, depth, gives in ways:
                b.y = b.y - gives.take(_standing(b, steps, depth))
            yield x, b

    def renewed(data: DataFrame, done: list[Tree]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in batches:
                for x, b in less(p, done):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([b.y.tobytes()], pa.binary())], names=["x", "y"])

        return data.mapInArrow(run, "x binary, y binary").persist()

    def summed(data: DataFrame, tree: Tree, nodes: list[int], done: list[Tree]) -> dict[int, np.ndarray]:
        shape = (len(nodes), s.k, s.wide, 2)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            steps, depth, (asked, place) = _steps(tree, s.wide), _depth(tree), _places(tree, nodes)
            found = _Sums(-(-s.k // 2), len(nodes), s.wide)
            for p in batches:
                for _, b in less(p, done):
                    at = _standing(b, steps, depth)
                    own = np.flatnonzero(asked.take(at))
                    found.add(b, own, place.take(at.take(own)), np.rint(-b.y.take(own)))
            total = _by_feature(found.apart(), s.k, s.wide)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

        def add(key: tuple, t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b, np.int64) for b in t.column("sums").to_pylist())
            return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

        parts, n = data.mapInArrow(partial, "part long, sums binary"), n_parts
        while n > FAN_IN:
            n = -(-n // FAN_IN)
            parts = parts.groupBy((F.col("part") % n).alias("_group")).applyInArrow(add, "part long, sums binary")
        total = np.zeros(int(np.prod(shape)), np.int64)
        for r in parts.select("sums").collect():  # at most FAN_IN
            total += np.frombuffer(r["sums"], np.int64)
        return dict(zip(nodes, total.reshape(shape)))

    forest: list[Tree] = []
    recent: list[Tree] = []
    for _ in range(s.trees):
        recent.append(grow_tree(lambda tree, nodes: summed(data, tree, nodes, recent), s.growth, s.depth, s.leaves, s.lam, s.least)[0])
        if len(recent) == RENEW:
            forest += recent
            old, data, recent = data, renewed(data, recent), []
            data.count()
            if old is not first or not SHARED.get():
                old.unpersist()
    if data is not first or not SHARED.get():
        data.unpersist()
    return forest + recent


def _prepare(df: DataFrame, features: list[str], label: str, bins: int, s: Settings) -> tuple[DataFrame, list[list[float]], int]:
    """(binned rows with a label, bounds of the bins, number of rows); what they say of the label goes to the settings."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("double").alias("_y")).filter("_y IS NOT NULL")
    stats = rows.agg(F.count("*"), F.avg("_y"), F.min("_y"), F.max("_y"), *(F.min(F.when(~F.isnan(c), F.col(c))) for c in features)).first()
    edges = bin_edges(rows, features, bins, [v if v is not None else 0.0 for v in stats[4:]])
    s.base, s.k, s.wide = float(np.float32(stats[1] or 0.0)), len(features), max((len(e) for e in edges), default=0) + 1
    # Gradients as whole numbers of 2 ** -30 of the largest.
    s.unit = float(max(abs((stats[2] or 0.0) - s.base), abs((stats[3] or 0.0) - s.base)) or 1.0) / (1 << 30)
    return rows.select(gram.packed([*features, "_y"])).mapInArrow(_binned(edges, s), "x binary, y binary"), edges, stats[0]


class Shared:
    """What several models of one table share, made by the first one that asks: binned rows, held until close(), and sums of products."""

    def __init__(self):
        self.lock, self.found = Lock(), {}
        self.sums_lock, self.sums = Lock(), {}

    def gram(self, df: DataFrame, columns: list[str]) -> gram.Block | None:
        with self.sums_lock:
            if tuple(columns) not in self.sums:
                self.sums[tuple(columns)] = gram.gram(df, columns)
            return self.sums[tuple(columns)]

    def prepared(self, df: DataFrame, features: list[str], label: str, bins: int, s: Settings) -> tuple[DataFrame, list[list[float]], int]:
        with self.lock:
            key = (*features, label, bins)
            if key not in self.found:
                data, edges, count = _prepare(df, features, label, bins, s)
                self.found[key] = _spread(data, count).persist(), edges, count, (s.base, s.k, s.wide, s.unit)
            *out, (s.base, s.k, s.wide, s.unit) = self.found[key]
            return tuple(out)

    def close(self) -> None:
        for data, *_ in self.found.values():
            data.unpersist()


#: Of the models that are fitted side by side on one table.
SHARED: ContextVar[Shared | None] = ContextVar("shared", default=None)


def _spread(data: DataFrame, count: int) -> DataFrame:
    return data.repartition(max(min(data.sparkSession.sparkContext.defaultParallelism, -(-count // BLOCK)), -(-count // FOREST_ROWS), 1))


def _prepared(df: DataFrame, features: list[str], label: str, bins: int, s: Settings) -> tuple[DataFrame, list[list[float]], int]:
    return (SHARED.get().prepared if SHARED.get() else _prepare)(df, features, label, bins, s)


def _scorer(features: list[str], edges: list[list[float]], base: float, rate: float, forest: list[Tree]) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            wide = max((len(e) for e in edges), default=0) + 1
            ways = [(_steps(t, wide), _depth(t), rate * values(t)) for t in forest]
            for p in parts:
                x = np.column_stack([np.searchsorted(e, p[c].fillna(-np.inf).to_numpy(float), "left") for c, e in zip(features, edges)])
                b, y = _Block(x.astype(np.uint8), np.full(len(p), base), wide), np.full(len(p), base)
                for steps, depth, gives in ways:
                    y = y + gives.take(_standing(b, steps, depth))
                p["prediction"] = y
                yield p

        schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "prediction double"])
        return df.mapInPandas(predict, schema)

    return score


def fit_histogram(growth: str, trees: int = TREES, depth: int = 6, leaves: int = 31, rate: float = 0.1, lam: float = 1.0, bins: int = 32, barrier: bool | None = None):
    """A fit(df, features, label) of boosted trees with squared loss. Rows without a label take no part; a null or NaN feature is less than all numbers.

    `barrier` chooses the one job or the job for each level; by default the number of rows does. Both give the same trees."""

    def fit(df: DataFrame, features: list[str], label: str) -> Scorer:
        s = Settings(growth, trees, depth, leaves, rate, lam)
        data, edges, count = _prepared(df, features, label, bins, s)
        slots = df.sparkSession.sparkContext.defaultParallelism
        # Its share of the slots, or as many as hold the rows; barrier jobs beside each other wait for their turn.
        n = 1 if count <= LEAST_ROWS else max(1, min(TASKS, slots, max(slots // BESIDE.get(), -(-count // TASK_ROWS))))
        # Of a level's nodes half are counted at most, 16 bytes a bin and a third more as text.
        fits = count <= n * TASK_ROWS and (n == 1 or n * (1 << max(depth - 2, 0)) * s.k * s.wide * 22 <= MESSAGES)
        if fits if barrier is None else barrier:
            forest = pickle.loads(data.repartition(n).mapInArrow(_barrier(s), "model binary", barrier=True).collect()[0]["model"])
        else:
            forest = _by_levels(data, s)
        return _scorer(features, edges, s.base, rate, [[(*n[:4], n[4] * s.unit) for n in t] for t in forest])

    return fit


#: How often a row is drawn, by 16 random bits: Poisson with mean 1, as drawing with replacement has in the limit.
DRAWS = np.searchsorted(np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(8)]) * (1 << 16), np.arange(1 << 16), "right").astype(np.uint8)


def _drawn(n: int, draws: np.ndarray, *seeds: int) -> np.ndarray:
    """How often each of n rows is drawn."""
    return draws.take(np.random.Generator(np.random.SFC64(seeds)).integers(0, 1 << 16, n, np.uint16))


def fit_forest(trees: int = TREES, depth: int = 8, bins: int = 32, seed: int = 42, draws: np.ndarray = DRAWS):
    """A fit(df, features, label) of a random forest: each tree of its own draw of the rows, with all features, leaves of means. All trees grow in step, by a job for each level:
    tasks hold some FOREST_ROWS rows, their sums meet by tree, where splits are chosen. The driver gets the choices; sums stay with the executors, as the next level's parents.
    Which rows are drawn depends on how they are batched."""

    def fit(df: DataFrame, features: list[str], label: str) -> Scorer:
        s = Settings("level", trees, depth, 0, 1.0, 0.0)
        data, edges, count = _prepared(df, features, label, bins, s)
        if not SHARED.get():
            data = _spread(data, count).persist()
        state: list[DataFrame] = []

        def decided(asked: dict[int, tuple[Tree, list[tuple[int, int, int]]]]) -> dict[int, dict[int, Choice]]:
            held = df.sparkSession.sparkContext.broadcast(asked)

            def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                blocks = list(_blocks(batches, s))
                own = [zlib.crc32(b.pairs, zlib.crc32(b.y)) for b in blocks]  # a block's draws depend on its rows, so all levels draw the same
                for t, (tree, families) in held.value.items() if blocks else ():
                    nodes = [small for _, small, _ in families]
                    steps, depth, (asked, place) = _steps(tree, s.wide), _depth(tree), _places(tree, nodes)
                    total = _Sums(-(-s.k // 2), len(nodes), s.wide)
                    for b, key in zip(blocks, own):
                        w = _drawn(len(b), draws, seed, t, key)
                        rows = np.flatnonzero(w > 0)
                        at = _standing(b, steps, depth, rows)
                        some = np.flatnonzero(asked.take(at))
                        rows = rows.take(some)
                        w = w.take(rows)
                        total.add(b, rows, place.take(at.take(some)), -np.rint(b.y.take(rows)) * w, w)
                    yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([_by_feature(total.apart(), s.k, s.wide).tobytes()], pa.binary())], names=["tree", "sums"])

            def met(key: tuple, found: pa.Table, before: pa.Table | None = None) -> pa.Table:
                tree, families = held.value.get(key[0].as_py(), ([], []))  # none of a tree that is done
                each = lambda v: np.frombuffer(v, np.int64).reshape(-1, s.k, s.wide, 2)
                total = sum(each(v) for v in found.column("sums").to_pylist()) if families else []
                parents = {n: v for r in (before.to_pylist() if before else ()) for n, v in zip(r["nodes"], each(r["sums"]))}
                sums = with_sisters(dict(zip([small for _, small, _ in families], total)), families, parents)
                choices = {n: chosen(v, s.lam, s.least) for n, v in sums.items()}
                kept = [n for n in sums if choices[n][1] >= 0] if families and _depth(tree) + 1 < depth else []
                columns = [pa.array([key[0].as_py()]), pa.array([kept], pa.list_(pa.int64())), pa.array([b"".join(sums[n].tobytes() for n in kept)], pa.binary()), pa.array([pickle.dumps(choices)], pa.binary())]
                return pa.Table.from_arrays(columns, names=["tree", "nodes", "sums", "choices"])

            kinds, parts = "tree long, nodes array<long>, sums binary, choices binary", data.mapInArrow(partial, "tree long, sums binary").groupBy("tree")
            if state:
                new = parts.cogroup(state[-1].groupBy("tree")).applyInArrow(lambda key, found, before: met(key, found, before), kinds)
            else:
                new = parts.applyInArrow(lambda key, found: met(key, found), kinds)
            state.append(new.persist())
            out = {r["tree"]: pickle.loads(r["choices"]) for r in state[-1].select("tree", "choices").collect()}  # for each tree some numbers a node, whatever the rows are
            if len(state) > 1:
                state.pop(0).unpersist()
            held.unpersist()
            return {t: out.get(t, {}) for t in asked}

        steps = {t: deciding(depth, s.lam, s.least) for t in range(trees)}
        asked, forest = {t: next(g) for t, g in steps.items()}, {}
        while asked:
            choices = decided(asked)
            for t in list(asked):
                try:
                    asked[t] = steps[t].send(choices[t])
                except StopIteration as e:
                    forest[t] = e.value[0]
                    del asked[t]
        for left in state:
            left.unpersist()
        if not SHARED.get():
            data.unpersist()
        return _scorer(features, edges, s.base, 1.0, [[(*n[:4], n[4] * s.unit / trees) for n in forest[t]] for t in range(trees)])

    return fit


def _depth(tree: Tree) -> int:
    """Splits between the root and the lowest node."""
    down = [0] * len(tree)
    for k, n in enumerate(tree):
        for child in n[2:4] if n[0] >= 0 else ():
            down[child] = down[k] + 1
    return max(down)
