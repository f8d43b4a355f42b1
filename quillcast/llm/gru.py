"""A gated recurrent language model in numpy: training by truncated backpropagation, and log-likelihoods of whole documents.

Words are numbers below SIZE * SIZE, dealt in order into SIZE classes of SIZE words: the output is a softmax over classes, then one over the words of the
target's class. Documents lie one after the other in lanes that are walked in windows of some steps; a lane's state goes on from window to window
and is reset where a document begins, so every word is predicted from all words of its document before it.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Width of the state; classes, and words of a class.
HIDDEN, SIZE = 16, 64
#: Lanes of a window in training, at least and at most: as many as make about WINDOWS steps of descent of a pass. Steps of a window, and both in scoring.
TRAIN_LANES, MOST_LANES, WINDOWS, TRAIN_STEPS = 64, 512, 250, 16
LANES, STEPS = 512, 64
#: Rows of outputs that are computed at once in scoring.
ROWS = 16384
RATE, EPSILON = 0.05, 1e-4
END, OTHER = 0, 1
#: Shapes of the parameters: gates by input word, gates by state, class and word outputs.
SHAPES = {"x": (SIZE * SIZE, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, SIZE), "bc": (SIZE,), "ww": (SIZE, HIDDEN, SIZE), "bw": (SIZE, SIZE)}
Params = dict[str, np.ndarray]


def start(counts: np.ndarray, seed: int = 11) -> Params:
    """Parameters of which all predictions are the shares of `counts` (by word number; words without a count have probability 0)."""
    rng = np.random.default_rng(seed)
    c = np.zeros(SIZE * SIZE)
    c[: len(counts)] = counts
    c = c.reshape(SIZE, SIZE)
    by_class = c.sum(axis=1)
    log = lambda v, of: np.where(v > 0, np.log(np.maximum(v, 1e-300) / np.maximum(of, 1e-300)), -1e4)
    p = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    p["x"][:] = rng.normal(0, 0.5, SHAPES["x"])
    p["u"][:] = rng.normal(0, HIDDEN**-0.5, SHAPES["u"])
    p["bc"][:] = log(by_class, by_class.sum())
    p["bw"][:] = log(c, by_class[:, None])
    return p


def pack(p: Params) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in SHAPES])


def unpack(v: np.ndarray) -> Params:
    cuts = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])[:-1]
    return {k: x.reshape(s).astype(np.float32) for (k, s), x in zip(SHAPES.items(), np.split(v, cuts))}


class Lanes:
    """Documents (targets, each ending with END) dealt to at most `n` lanes of nearly equal length, longest lane first."""

    def __init__(self, docs: list[np.ndarray], n: int):
        sizes = [len(d) for d in docs]
        free, own = [(0, k) for k in range(min(n, len(docs)))], [[] for _ in range(min(n, len(docs)))]
        for d in np.argsort([-s for s in sizes], kind="stable").tolist():
            size, k = heapq.heappop(free)
            own[k].append(d)
            heapq.heappush(free, (size + sizes[d], k))
        own.sort(key=lambda x: -sum(sizes[d] for d in x))
        #: Documents in the order of their targets, the targets, where documents begin.
        self.order = [d for x in own for d in x]
        self.targets = np.concatenate([docs[d] for d in self.order]).astype(np.int64)
        self.lengths = np.array([sum(sizes[d] for d in x) for x in own])
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.docs_at = np.append(0, np.cumsum([sizes[d] for d in self.order]))
        self.first = np.zeros(len(self.targets), bool)
        self.first[self.docs_at[:-1]] = True
        self.inputs = np.append(END, self.targets[:-1])
        self.inputs[self.first] = END

    def windows(self, steps: int):
        """(places, which count) of each window, steps x lanes that go on."""
        for at in range(0, int(self.lengths[0]), steps):
            lanes = int(np.searchsorted(-self.lengths, -at, "left"))
            t = at + np.arange(min(steps, int(self.lengths[0]) - at))[:, None]
            real = t < self.lengths[:lanes]
            yield np.where(real, self.begin[:lanes] + t, self.begin[:lanes]), real


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def states(p: Params, h: np.ndarray, inputs: np.ndarray, first: np.ndarray, tape: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each step (steps, lanes, HIDDEN), and the last one. `tape` gets what training needs of all steps."""
    out = np.empty((*inputs.shape, HIDDEN), np.result_type(h, p["x"]))
    go = (~first).astype(out.dtype)[:, :, None]
    kept = {k: np.empty_like(out) for k in ("h", "z", "r", "n", "gn")} | {"go": go} if tape is not None else {}
    for t in range(len(inputs)):
        a = p["x"].take(inputs[t], axis=0)
        h = h * go[t]
        g = h @ p["u"]
        zr = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * gn)
        if tape is not None:
            for k, v in (("h", h), ("z", z), ("r", r), ("n", n), ("gn", gn)):
                kept[k][t] = v
        h = h - n
        h *= z
        h += n
        out[t] = h
    if tape is not None:
        tape.update(kept)
    return out, h


def _softmax(c: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of outputs become their exponentials: (logarithm of each row's share at `own`, sums of rows). Only outputs that could leave the range of floats are shifted."""
    most = c[at, own]
    if not (len(c) and most.min() > -60 and c.max() < 60):
        c -= c.max(axis=1, keepdims=True)
        most = c[at, own]
    np.exp(c, out=c)
    total = c @ np.ones(c.shape[1], c.dtype)
    return most - np.log(total), total


def predicted(p: Params, h: np.ndarray, targets: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, dict | None]:
    """Natural logarithm of the probability of each target after state h; with weights also the gradients of -sum(weight * log)."""
    kind, at = targets // SIZE, np.arange(len(h))
    # Rows by class: of a class the states are one matrix, all else is done on all rows at once.
    order = np.argsort(kind.astype(np.uint8), kind="stable")
    kind, word = kind.take(order), (targets % SIZE).take(order)
    # A column of ones beside the states: the biases are rows of the matrices.
    one = np.ones((len(h), HIDDEN + 1), np.result_type(h, p["wc"]))
    one[:, :HIDDEN] = h.take(order, axis=0)
    by_class, by_word = np.vstack([p["wc"], p["bc"]]), np.concatenate([p["ww"], p["bw"][:, None]], axis=1)
    cuts = np.searchsorted(kind, np.arange(SIZE + 1)).tolist()
    parts = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    c = one @ by_class
    log, total = _softmax(c, at, kind)
    w = np.empty((len(h), SIZE), one.dtype)
    for k, own in parts:
        np.matmul(one[own], by_word[k], out=w[own])
    inner, inner_total = _softmax(w, at, word)
    out = np.empty(len(h), one.dtype)
    out[order] = log + inner
    if weight is None:
        return out, None
    q = weight.take(order)
    c *= (q / total)[:, None]
    c[at, kind] -= q
    w *= (q / inner_total)[:, None]
    w[at, word] -= q
    of_class, of_word = one.T @ c, np.zeros(by_word.shape, one.dtype)
    back = c @ p["wc"].T
    turned = np.ascontiguousarray(p["ww"].transpose(0, 2, 1))
    for k, own in parts:
        np.matmul(one[own].T, w[own], out=of_word[k])
        back[own] += w[own] @ turned[k]
    grads = {"wc": of_class[:-1], "bc": of_class[-1], "ww": of_word[:, :-1], "bw": of_word[:, -1]}
    grads["h"] = np.empty_like(back)
    grads["h"][order] = back
    return out, grads


def gradients(p: Params, h: np.ndarray, inputs: np.ndarray, first: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[Params, np.ndarray, float]:
    """(gradients of the mean loss of a window, the last state, the sum of log probabilities). The gradient of x comes as (words, rows)."""
    tape: dict = {}
    hs, last = states(p, h, inputs, first, tape)
    weight = (real.reshape(-1) / real.sum()).astype(hs.dtype)
    log, g = predicted(p, hs.reshape(-1, HIDDEN), targets.reshape(-1), weight)
    dhs = g.pop("h").reshape(hs.shape)
    z, r, n, go = tape["z"], tape["r"], tape["n"], tape["go"]
    # What each step multiplies the gradient of its state with, for all steps at once.
    to_n = (1 - z) * (1 - n * n)
    to_z = (tape["h"] - n) * z * (1 - z)
    to_r = tape["gn"] * r * (1 - r)
    da, dg = np.empty((2, *inputs.shape, 3 * HIDDEN), hs.dtype)
    dh, turned = np.zeros_like(last), np.ascontiguousarray(p["u"].T)
    for t in range(len(inputs) - 1, -1, -1):
        dh += dhs[t]
        own, dn = dg[t], da[t, :, 2 * HIDDEN :]
        np.multiply(dh, to_n[t], out=dn)
        np.multiply(dh, to_z[t], out=own[:, :HIDDEN])
        np.multiply(dn, to_r[t], out=own[:, HIDDEN : 2 * HIDDEN])
        np.multiply(dn, r[t], out=own[:, 2 * HIDDEN :])
        dh *= z[t]
        dh += own @ turned
        dh *= go[t]
    da[:, :, : 2 * HIDDEN] = dg[:, :, : 2 * HIDDEN]
    g["u"] = tape["h"].reshape(-1, HIDDEN).T @ dg.reshape(-1, 3 * HIDDEN)
    flat, words = da.reshape(-1, 3 * HIDDEN), inputs.reshape(-1).astype(np.uint16)
    order = np.argsort(words, kind="stable")
    words = words.take(order)
    cuts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    g["x"] = (words[cuts].astype(np.int64), np.add.reduceat(flat.take(order, axis=0), cuts, axis=0))
    return g, last, float((log * real.reshape(-1)).sum())


def train(p: Params, docs: list[np.ndarray], rate: float = RATE, scale: Params | None = None) -> tuple[Params, Params, int]:
    """One pass over docs by windows of truncated backpropagation, with steps scaled by the squares of gradients so far (Adagrad): (parameters, squares, words)."""
    p = {k: v.copy() for k, v in p.items()}
    scale = {k: np.full(s, EPSILON**2, np.float32) for k, s in SHAPES.items()} if scale is None else {k: v.copy() for k, v in scale.items()}
    lanes = Lanes(docs, min(MOST_LANES, max(TRAIN_LANES, sum(len(d) for d in docs) // (WINDOWS * TRAIN_STEPS))))
    h = np.zeros((0, HIDDEN), np.float32)
    for at, real in lanes.windows(TRAIN_STEPS):
        h = h[: at.shape[1]] if len(h) else np.zeros((at.shape[1], HIDDEN), np.float32)
        g, h, _ = gradients(p, h, lanes.inputs[at], lanes.first[at], lanes.targets[at], real)
        for k, v in g.items():
            if k == "x":
                rows, v = v
                squares = scale[k].take(rows, axis=0)
                squares += v * v
                scale[k][rows] = squares
                np.sqrt(squares, out=squares)
                v *= rate
                v /= squares
                p[k][rows] = p[k].take(rows, axis=0) - v
            else:
                scale[k] += v * v
                p[k] -= rate * v / np.sqrt(scale[k])
    return p, scale, len(lanes.targets)


def log_likelihoods(p: Params, docs: list[np.ndarray]) -> np.ndarray:
    """The natural logarithm of the probability of each document, its END included."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    lanes = Lanes(docs, LANES)
    logs = np.zeros(len(lanes.targets))
    h = np.zeros((0, HIDDEN), np.float32)
    for at, real in lanes.windows(STEPS):
        h = h[: at.shape[1]] if len(h) else np.zeros((at.shape[1], HIDDEN), np.float32)
        hs, h = states(p, h, lanes.inputs[at], lanes.first[at])
        own = real.reshape(-1)
        flat, hs = at.reshape(-1), hs.reshape(-1, HIDDEN)
        if not own.all():
            flat, hs = flat[own], hs[own]
        for k in range(0, len(flat), ROWS):
            some = flat[k : k + ROWS]
            logs[some] = predicted(p, hs[k : k + ROWS], lanes.targets.take(some))[0]
    out[lanes.order] = np.add.reduceat(logs, lanes.docs_at[:-1])
    return out
