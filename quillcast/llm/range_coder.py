"""An adaptive, context-mixing range coder for blocks of token ids, in numpy over many lanes at once.

A block is cut into LANES stretches that are coded in step; its model starts empty (blocks are independent)
and is shared by its lanes. For each id three orders predict: order 0 by the counts of ids so far (renewed
from round to round), order 1 and order 2 by the id that last followed the previous one or two ids. The
weight of the latter two depends on how often such a prediction, at its present confidence, has held in
this block. The mixture is one distribution over all ids, coded by one arithmetic coding step in each lane;
the decoder keeps the same model, so it needs nothing but the bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 512
#: Blocks coded together, bits of the order-1 and order-2 tables, longest round (in steps), and the bound of order-0 totals.
TOGETHER, BITS1, BITS2, ROUND, ORDER0_BITS = 8, 12, 14, 64, 21
#: A table of at most so many entries for each block says where the search for an id begins.
STARTS = 1 << 14
MAGIC = b"QTB1"
HEAD = "<4sIIHII"  # magic, vocabulary, ids, lanes, crc of the ids, crc of the rest

_U = np.uint64
_TOP, _BOTTOM, _WORD = _U(1 << 48), _U(1 << 40), _U(16)


class _Model:
    """The predictions for the lanes of several blocks; `block` says which block a lane belongs to.

    Lanes come longest first, so those still in use at any step are the first m. A table entry is the id
    that followed last, times 4, plus its confidence; -4 is none yet."""

    def __init__(self, sizes: np.ndarray, vocabulary: int, block: np.ndarray):
        self.n, self.v, self.block = len(sizes), vocabulary, block
        self.step = np.maximum(1, np.minimum(32, (1 << ORDER0_BITS) // np.maximum(sizes, 1)))
        self.counts = np.ones((self.n, vocabulary), np.int32)
        self.base, self.cells = block * (vocabulary + 1), block << 5
        self.base1, self.base2 = block << BITS1, block << BITS2
        self.table1 = np.full(self.n << BITS1, -4, np.int32)
        self.table2 = np.full(self.n << BITS2, -4, np.int32)
        self.held = np.full((3, self.n * 32), 0.4)  # by cell: order 2 held, order 1 held, neither
        self.p1, self.p2 = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        self.renew()

    def renew(self) -> None:
        """Begin a round: order-0 places and the weights of the cells from all that was coded before."""
        place = np.zeros((self.n, self.v + 1), np.int32)
        np.cumsum(self.counts, axis=1, out=place[:, 1:])
        total = place[:, -1].astype(np.int64)
        self.place, self.total = place.reshape(-1), total[self.block]
        self.weight = np.minimum(self.held[:2] / (self.held[2] + 1), 256.0) * np.repeat(total, 32)
        self.weight = self.weight.astype(np.int64)
        self.seen: list[np.ndarray] = []
        self.hits = np.zeros(self.n * 96, np.int64)

    def begin_search(self) -> None:
        """For the decoder: for each stretch of 2 ** self.bits values, the id of its first value."""
        most = int(self.total.max())
        self.bits = max(0, most.bit_length() - STARTS.bit_length() + 1)
        edges = np.arange((most >> self.bits) + 2) << self.bits
        place = self.place.reshape(self.n, -1)
        self.starts = np.concatenate([np.minimum(np.searchsorted(row, edges, "right"), self.v) - 1 for row in place])
        self.first_start = self.block * len(edges)

    def find(self, lanes: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The id whose order-0 stretch holds each value."""
        base, stretch = self.base[lanes], self.first_start[lanes] + (value >> self.bits)
        low, high = self.starts[stretch], self.starts[stretch + 1]
        go = np.flatnonzero(low < high)
        while len(go):
            mid = (low[go] + high[go] + 1) >> 1
            up = self.place[base[go] + mid] <= value[go]
            low[go] = np.where(up, mid, low[go])
            high[go] = np.where(up, high[go], mid - 1)
            go = go[low[go] < high[go]]
        return low

    def predict(self, m: int) -> tuple:
        """For the first m lanes: places in the tables, their entries, predicted ids and weights of order 1 and 2, cells."""
        x = self.p1[:m] * 2654435761
        h1 = ((x >> 9) & ((1 << BITS1) - 1)) + self.base1[:m]
        h2 = (((x + self.p2[:m] * 2656155657) >> 11) & ((1 << BITS2) - 1)) + self.base2[:m]
        e1, e2 = self.table1[h1], self.table2[h2]
        c1, c2 = e1 >> 2, e2 >> 2
        same = c1 == c2
        cell = self.cells[:m] + ((e2 & 3) << 3) + ((e1 & 3) << 1) + same
        w1, w2 = self.weight[1][cell] * ~(same | (c1 < 0)), self.weight[0][cell] * (c2 >= 0)
        return h1, h2, e1, e2, c1, c2, w1, w2, cell

    def update(self, m: int, ids: np.ndarray, known: tuple) -> None:
        h1, h2, e1, e2, c1, c2, _, _, cell = known
        hit1, hit2 = c1 == ids, c2 == ids
        self.hits += np.bincount(cell * 3 + np.where(hit2, 0, 2 - hit1), minlength=len(self.hits))
        new = ids << 2
        self.table1[h1] = np.where(hit1, e1 + ((e1 & 3) < 3), np.where(e1 & 3, e1 - 1, new))
        self.table2[h2] = np.where(hit2, e2 + ((e2 & 3) < 3), np.where(e2 & 3, e2 - 1, new))
        self.seen.append(self.block[:m] * self.v + ids)
        self.p2[:m] = self.p1[:m]
        self.p1[:m] = ids

    def close(self) -> None:
        """End a round."""
        new = np.bincount(np.concatenate(self.seen), minlength=self.n * self.v).reshape(self.n, self.v)
        self.counts += (new * self.step[:, None]).astype(np.int32)
        self.held += self.hits.reshape(-1, 3).T


def _rounds(steps: int):
    """(first step, end) of each round: short ones first."""
    at, size = 0, 2
    while at < steps:
        yield at, min(steps, at + size)
        at += size
        size = min(size * 2, ROUND)


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lanes of all blocks, longest first: number, first id, number of ids, block. And for each step the lanes in use."""
    length = -(-sizes // LANES)
    first = np.minimum(np.arange(LANES)[None, :] * length[:, None], sizes[:, None])
    count = np.minimum(first + length[:, None], sizes[:, None]) - first
    first = (first + (np.cumsum(sizes) - sizes)[:, None]).reshape(-1)
    order = np.argsort(-count.reshape(-1), kind="stable")
    return order, first[order], count.reshape(-1)[order], order // LANES


def _used(count: np.ndarray) -> list[int]:
    """For each step, how many lanes are still in use."""
    return np.searchsorted(-count, -np.arange(int(count.max(initial=0))), "left").tolist()


def encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Each block of ids (below `vocabulary`) as bytes; an empty block is a header only."""
    out: list[bytes] = []
    for k in range(0, len(blocks), TOGETHER):
        out += _encode(blocks[k : k + TOGETHER], vocabulary)
    return out


def _encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    sizes = np.array([len(b) for b in blocks], np.int64)
    every = np.concatenate([np.asarray(b, np.int64) for b in blocks])
    order, first, count, block = _lanes(sizes)
    model, in_use = _Model(sizes, vocabulary, block), _used(count)
    low, span = np.zeros(len(count), _U), np.full(len(count), 2**64 - 1, _U)
    words = np.zeros((len(count), len(in_use) + 16), np.uint16)
    used, most = np.zeros(len(count), np.int64), 0
    for begin, end in _rounds(len(in_use)):
        if begin:
            model.close()
            model.renew()
        for t in range(begin, end):
            m = in_use[t]
            ids = every[first[:m] + t]
            known = model.predict(m)
            c1, c2, w1, w2 = known[4:8]
            place = model.base[:m] + ids
            start = model.place[place]
            size = model.place[place + 1] - start + w1 * (c1 == ids) + w2 * (c2 == ids)
            start = start + w1 * (c1 < ids) + w2 * (c2 < ids)
            lo, sp = low[:m], span[:m]
            r = sp // (model.total[:m] + w1 + w2).view(_U)
            lo += r * start.view(_U)
            np.multiply(r, size.view(_U), out=sp)
            go = _narrow(lo, sp)
            while len(go):
                if most + 4 > words.shape[1]:
                    words = np.pad(words, ((0, 0), (0, words.shape[1])))
                words[go, used[go]] = lo[go] >> _U(48)
                used[go] += 1
                most += 1
                lo[go] <<= _WORD
                sp[go] <<= _WORD
                go = go[_narrow(lo, sp, go)]
            model.update(m, ids, known)
        most = int(used.max())
    # Two more words name a number within each lane's last interval.
    some = np.flatnonzero(count)
    words = np.pad(words, ((0, 0), (0, 2)))
    final = ((low[some] >> _U(39)) + _U(1)) << _U(39)
    words[some, used[some]] = final >> _U(48)
    words[some, used[some] + 1] = (final >> _U(32)) & _U(0xFFFF)
    used[some] += 2
    back = np.argsort(order)
    used, words = used[back], words[back]
    out = []
    for k, ids in enumerate(blocks):
        u, w = used[k * LANES : (k + 1) * LANES], words[k * LANES : (k + 1) * LANES]
        body = u.astype("<u4").tobytes() + w[np.arange(w.shape[1])[None, :] < u[:, None]].astype("<u2").tobytes()
        out.append(struct.pack(HEAD, MAGIC, vocabulary, len(ids), LANES, zlib.crc32(np.asarray(ids, "<u4").tobytes()), zlib.crc32(body)) + body)
    return out


def _narrow(lo: np.ndarray, sp: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Which lanes (of `at`) have 16 settled bits to shift out; intervals too small to go on are cut at the next bound first."""
    a, b = (lo, sp) if at is None else (lo[at], sp[at])
    top = (a ^ (a + b)) < _TOP
    small = ~top & (b < _BOTTOM)
    if small.any():
        cut = np.flatnonzero(small)
        where = cut if at is None else at[cut]
        sp[where] = (~lo[where] + _U(1)) & (_BOTTOM - _U(1))
        top |= small
    return np.flatnonzero(top)


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids (uint32) of each block; ValueError if a checksum fails."""
    out: list[np.ndarray] = []
    for k in range(0, len(blocks), TOGETHER):
        out += _decode(blocks[k : k + TOGETHER])
    return out


def _decode(blocks: list[bytes]) -> list[np.ndarray]:
    heads, streams = [], []
    for data in blocks:
        head = struct.unpack_from(HEAD, data)
        body = data[struct.calcsize(HEAD) :]
        if head[0] != MAGIC or head[3] != LANES or zlib.crc32(body) != head[5]:
            raise ValueError("a damaged block of token ids")
        u = np.frombuffer(body, "<u4", LANES).astype(np.int64)
        heads.append(head)
        streams.append((u, np.frombuffer(body, "<u2", offset=4 * LANES)))
    vocabulary = heads[0][1]
    if any(h[1] != vocabulary for h in heads):
        return [x for data in blocks for x in _decode([data])]
    sizes = np.array([h[2] for h in heads], np.int64)
    order, first, count, block = _lanes(sizes)
    model, in_use = _Model(sizes, vocabulary, block), _used(count)
    used = np.concatenate([u for u, _ in streams])
    begin = np.cumsum(used) - used
    # A lane that reads beyond its words sees those of the next lane: the two words that end a lane settle its last id.
    words = np.concatenate([*(s for _, s in streams), np.zeros(8, np.uint16)]).astype(_U)
    pos = begin[order]
    low, span, code = np.zeros(len(count), _U), np.full(len(count), 2**64 - 1, _U), np.zeros(len(count), _U)
    for _ in range(4):
        code = (code << _WORD) | words[np.minimum(pos, len(words) - 1)]
        pos += 1
    every = np.zeros(int(sizes.sum()), np.int64)
    model.begin_search()
    for start_step, end in _rounds(len(in_use)):
        if start_step:
            model.close()
            model.renew()
            model.begin_search()
        for t in range(start_step, end):
            m = in_use[t]
            known = model.predict(m)
            c1, c2, w1, w2 = known[4:8]
            base, total = model.base[:m], model.total[:m] + w1 + w2
            lo, sp, cd = low[:m], span[:m], code[:m]
            r = sp // total.view(_U)
            value = np.minimum((cd - lo) // r, (total - 1).view(_U)).view(np.int64)
            # Order 0's part of the value: off with the weights of the predictions that lie below it.
            # A value within a prediction's own stretch names its id.
            d1, d2 = np.maximum(c1, 0), np.maximum(c2, 0)
            at1, at2 = base + d1, base + d2
            first1 = model.place[at1] + w2 * (c2 < c1)
            first2 = model.place[at2] + w1 * (c1 < c2)
            over1 = value >= model.place[at1 + 1] + w2 * (c2 < c1) + w1
            over2 = value >= model.place[at2 + 1] + w1 * (c1 < c2) + w2
            in1 = ~over1 & (value >= first1) & (w1 > 0)
            in2 = ~over2 & (value >= first2) & (w2 > 0)
            rest = value - w1 * over1 - w2 * over2
            ids = np.where(in1, d1, d2).astype(np.int64)
            free = np.flatnonzero(~(in1 | in2))
            if len(free):
                ids[free] = model.find(free, rest[free])
            place = base + ids
            start = model.place[place]
            size = model.place[place + 1] - start + w1 * (c1 == ids) + w2 * (c2 == ids)
            start = start + w1 * (c1 < ids) + w2 * (c2 < ids)
            lo += r * start.view(_U)
            np.multiply(r, size.view(_U), out=sp)
            go = _narrow(lo, sp)
            while len(go):
                cd[go] = (cd[go] << _WORD) | words[np.minimum(pos[go], len(words) - 1)]
                pos[go] += 1
                lo[go] <<= _WORD
                sp[go] <<= _WORD
                go = go[_narrow(lo, sp, go)]
            every[first[:m] + t] = ids
            model.update(m, ids, known)
    out, at = [], 0
    for head in heads:
        ids = every[at : at + head[2]].astype("<u4")
        at += head[2]
        if zlib.crc32(ids.tobytes()) != head[4]:
            raise ValueError("a block of token ids fails its checksum")
        out.append(ids)
    return out
