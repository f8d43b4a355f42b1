"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

A byte-level BPE (A, over a blank and the text) and a piece BPE with byte fallback (B, which adds the blank itself) cut the
same bytes. Where a token of each ends at the same byte, a group ends. The ends of both are increasing numbers, and
between neighbouring groups of one token each the index of B minus that of A, the shift, stays the same. So
ends are compared at the current shift, 1, 2, 4, ... at a time, and equal stretches are jumped over; at the first
difference the group is resolved by moving on in whichever lies behind, which gives the shift from there on. Many stretches of about
LANE tokens, which begin at common ends, are walked in step in numpy.

What links count is bounded by the vocabularies: tokens that end together are each other's suffixes, so the possible
pairs are at most the bytes of all entries of both. Counts are held as one number for each possible pair.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm.common import batches_of, keep, table
from quillcast.llm.text_arrays import slices, text_buffers
from quillcast.llm.token_files import Encoder, gather, vocabulary_file

#: Tokens of a lane, tokens looked at to find where one begins, and the most that is compared at a time.
LANE, LOOK, WIDEST = 256, 64, 4096
#: Bytes of text that are aligned at a time.
SLICE_BYTES = 1 << 20
#: Stretches that a worker's cache of A keeps, and documents that a worker gets at a time.
MOST_KEPT, TOGETHER = 1 << 18, 1000
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
GROUPS = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte, by its rule: printable Latin-1 characters stand for themselves, the others
    follow from U+0100 on in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def after_blank(col: pa.Array, before: str = "") -> pa.Array:
    """`before`, a blank and each text."""
    blank, none = pa.scalar(f"{before} ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(blank, col.cast(pa.large_string()), none)


class Vocabulary:
    """The bytes of each id: one array of bytes, and where each id's begin."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.begin = np.append(0, np.cumsum([len(e) for e in entries]))
        self.size = np.diff(self.begin)
        self.entries = entries

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.data, self.begin, ids)[0]


class PlainEncoder(Encoder):
    """Ids of whole texts in which special tokens' strings are plain text."""

    def __init__(self, source: str, **more):
        super().__init__(source, **more)
        self.tokenizer.encode_special_tokens = True
        self.special = []


class Tokenizers:
    """Both tokenizers with the bytes of their entries and the pairs of ids that can end together."""

    def __init__(self, source: str, model: bytes):
        import sentencepiece

        self.a = PlainEncoder(source, most_kept=MOST_KEPT)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters, by_id = byte_letters(), {k: t for t, k in self.a.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.of_a = Vocabulary([bytes(letters[c] for c in by_id.get(k, "")) for k in range(max(by_id) + 1)])
        n = self.b.get_piece_size()
        # <unk> and control pieces stand for no bytes; texts that need them have no tokens.
        odd = [self.b.is_unknown(k) or self.b.is_control(k) or self.b.is_unused(k) for k in range(n)]
        piece = [self.b.id_to_piece(k) for k in range(n)]
        self.of_b = Vocabulary([b"" if odd[k] else bytes([int(piece[k][1:-1], 16)]) if self.b.is_byte(k) else piece[k].replace("▁", " ").encode() for k in range(n)])
        self.pairs = possible_pairs(self.of_a.entries, self.of_b.entries)
        self.stop = self.of_a.entries.index(b".")

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of A and of B."""
        # Behind a full stop, which is always a token of its own before a blank, the blank is cut like all others.
        a, n_a = self.a.encode(after_blank(col, "."))
        first = np.cumsum(n_a) - n_a
        if not (a[first] == self.stop).all():
            raise ValueError("a full stop before a blank isn't a token of its own")
        a, n_a = np.delete(a, first), n_a - 1
        lists = self.b.encode(col.to_pylist(), num_threads=1)
        n_b = np.array([len(x) for x in lists], np.int64)
        return a.astype(np.int64), n_a, np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum())), n_b


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All (id of A << 32 | id of B) whose bytes can end together, sorted: one entry is a suffix of the other."""
    ids: list[dict[bytes, list[int]]] = [{}, {}]
    for entries, own in ((a, ids[0]), (b, ids[1])):
        for k, e in enumerate(entries):
            if e:
                own.setdefault(e, []).append(k)
    found = {(i, j) for i, e in enumerate(a) for s in range(len(e)) for j in ids[1].get(e[s:], ())}
    found |= {(i, j) for j, e in enumerate(b) for s in range(len(e)) for i in ids[0].get(e[s:], ())}
    return np.sort(np.array([i << 32 | j for i, j in found], np.int64))


def lanes(ea: np.ndarray, eb: np.ndarray, size: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of A and B of stretches of about `size` tokens of A, each after a common end; the first is (0, 0)."""
    at = np.arange(size, len(ea), size)
    near = np.minimum(at[:, None] + np.arange(LOOK), len(ea) - 1)
    place = np.minimum(np.searchsorted(eb, ea[near]), len(eb) - 1)
    same = eb[place] == ea[near]
    own = np.flatnonzero(same.any(axis=1))
    k = same[own].argmax(axis=1)
    i, j = np.append(0, near[own, k] + 1), np.append(0, place[own, k] + 1)
    i, first = np.unique(i, return_index=True)
    inner = i < len(ea)
    return i[inner], j[first][inner]


def common_ends(ea: np.ndarray, eb: np.ndarray, size: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Indices in A and in B of the tokens that end together. ea and eb increase strictly and have the same last value."""
    if not len(ea):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = lanes(ea, eb, size)
    stop_i, stop_j = np.append(i[1:], len(ea)), np.append(j[1:], len(eb))
    width = np.ones(len(i), np.int64)
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(i):
        w = np.minimum(np.minimum(width, stop_i - i), stop_j - j)
        first = np.cumsum(w) - w
        k = np.arange(int(w.sum())) - np.repeat(first, w)
        same = ea[np.repeat(i, w) + k] == eb[np.repeat(j, w) + k]
        n = np.minimum(np.minimum.reduceat(np.where(same, WIDEST, k), first), w)
        runs.append((i, j, n))
        i, j = i + n, j + n
        whole = n == w
        width = np.where(whole, np.minimum(width * 2, WIDEST), 1)
        off = np.flatnonzero(~whole)
        if len(off):
            # The group that breaks the shift: move on in the one that lies behind.
            a, b = i[off], j[off]
            while True:
                x, y = ea[a], eb[b]
                behind = x < y
                ahead = x > y
                if not (behind.any() or ahead.any()):
                    break
                a, b = a + behind, b + ahead
            runs.append((a, b, np.ones(len(a), np.int64)))
            i[off], j[off] = a + 1, b + 1
        going = i < stop_i
        if not going.all():
            i, j, stop_i, stop_j, width = i[going], j[going], stop_i[going], stop_j[going], width[going]
    i, j, n = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(i, kind="stable")
    i, j, n = i[order], j[order], n[order]
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(i, n) + k, np.repeat(j, n) + k


_DIGITS = np.zeros((1 << 16, 6), np.uint8)
_N_DIGITS = np.ones(1 << 16, np.int64)
for _k in range(1, 5):
    _N_DIGITS[10**_k :] = _k + 1
for _k in range(5):
    _left = np.maximum(_N_DIGITS - 1 - _k, 0)
    _DIGITS[:, _k] = 0x30 + (np.arange(1 << 16) // 10**_left) % 10


def written(a: np.ndarray, b: np.ndarray, ia: np.ndarray, jb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of `a1,a2|b1;a3|b2,b3;` for all groups one after the other, where each token's begin, in the order written)."""
    group_a, group_b = np.searchsorted(ia, np.arange(len(a))), np.searchsorted(jb, np.arange(len(b)))
    before = np.append(0, jb + 1)
    at_a, at_b = np.arange(len(a)) + before[group_a], np.arange(len(b)) + ia[group_b] + 1
    ids, sep = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    sep[at_a[ia]], sep[at_b[jb]] = ord("|"), ord(";")
    if len(ids) and int(ids.max()) >= len(_DIGITS):
        raise ValueError("an id has more than five digits")
    size = _N_DIGITS[ids]
    out = _DIGITS[ids]
    out[np.arange(len(ids)), size] = sep
    return out[np.arange(6) <= size[:, None]], np.append(0, np.cumsum(size + 1))


def _worker(held) -> Tokenizers:
    """The tokenizers of this worker process, kept from task to task."""
    state = sys.modules.setdefault("quillcast_worker", types.ModuleType("quillcast_worker"))
    source, model = held.value
    key = hash((source, model))
    own = getattr(state, "tokenizers", None)
    if own is None or own[0] != key:
        state.tokenizers = own = (key, Tokenizers(source, model))
    return own[1]


def same_bytes(v: Vocabulary, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts (bytes and offsets) are what their tokens' bytes give when joined."""
    sizes = np.append(0, np.cumsum(v.size[ids]))
    ends = np.append(0, np.cumsum(counts))
    ok = np.diff(sizes[ends]) == np.diff(offs)
    if ok.all():
        joined, at, text = v.joined(ids), offs, data
    else:
        joined, at = v.joined(ids[np.repeat(ok, counts)]), np.append(0, np.cumsum(np.diff(offs)[ok]))
        text = data[np.repeat(ok, np.diff(offs))]
    wrong = np.flatnonzero(joined != text)
    if len(wrong):
        ok[np.flatnonzero(ok)[np.unique(np.searchsorted(at, wrong, "right") - 1)]] = False
    return ok


def _align(held, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _worker(held)
        for batch in batches:
            col = batch.column(1)
            for lo, hi in slices(text_buffers(col)[1], SLICE_BYTES):
                part = col.slice(lo, hi - lo).cast(pa.large_string()).fill_null("")
                a, n_a, b, n_b = t.encode(part)
                data, offs = text_buffers(after_blank(part))
                ok = (np.diff(offs) > 1) & same_bytes(t.of_a, a, n_a, data, offs) & same_bytes(t.of_b, b, n_b, data, offs)
                a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
                n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
                ia, jb = common_ends(np.cumsum(t.of_a.size[a]), np.cumsum(t.of_b.size[b]))
                # The last token of a text always ends a group.
                to_a, to_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
                to_group = np.searchsorted(ia, to_a)
                ids = batch.column(0).slice(lo, hi - lo)
                if whole:
                    lists = lambda v, to: pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(v, pa.int32()))
                    base = np.repeat(to_a[:-1], np.diff(to_group)), np.repeat(to_b[:-1], np.diff(to_group))
                    columns = [ids, lists(a, to_a), lists(b, to_b), lists(ia + 1 - base[0], to_group), lists(jb + 1 - base[1], to_group)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])
                    continue
                text, begin = written(a, b, ia, jb)
                view, cuts = memoryview(text), begin[to_a + to_b].tolist()
                digests = [hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]
                pairs = a[ia] << 32 | b[jb]
                links = np.minimum(np.searchsorted(t.pairs, pairs), len(t.pairs) - 1)
                if not (t.pairs[links] == pairs).all():
                    raise ValueError("linked tokens whose bytes don't end together")
                links = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(to_group * 4), pa.py_buffer(links.astype(np.int32))]).cast(pa.binary())
                columns = [ids, pa.array(n_a), pa.array(n_b), pa.array(np.diff(to_group)), pa.array(digests, pa.string()), links]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return run


def _tokenizers(docs: DataFrame, vocabulary: str | None, model: str | None):
    """Both files' contents (a few MB), broadcast."""
    with open(vocabulary or vocabulary_file(), encoding="utf-8") as f, open(model or model_file(), "rb") as g:
        return docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))


def groups(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): the ids of A and B, and for each group how many tokens of A and of B end with it or before.

    A null or empty text, and one that A or B doesn't give back byte for byte, has no tokens and no groups. Rows with the
    same or a null doc_id are rows of their own; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_align(_tokenizers(docs, vocabulary, model), True), GROUPS)


def _links(batch: pa.RecordBatch, name: str = "links") -> tuple[np.ndarray, np.ndarray]:
    """All link numbers of a batch, and where each row's end."""
    col = batch.column(batch.schema.names.index(name)).cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    links = np.frombuffer(data, np.int32, int(offs[-1] - offs[0]) // 4, int(offs[0])) if data and len(col) and offs[-1] > offs[0] else np.zeros(0, np.int32)
    return links, (offs - offs[0]) // 4 if len(col) else np.zeros(1, np.int64)


def _count(n_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_pairs, np.int64)
        for batch in batches:
            sums += np.bincount(_links(batch)[0], minlength=n_pairs)
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sums[own])], names=["pair", "n"])

    return run


def _measure(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = counts.value
        for batch in batches:
            links, to = _links(batch)
            total, top = np.append(0, np.cumsum(n[links])), np.append(0, np.cumsum(best[links]))
            columns = [batch.column(k) for k in range(4)] + [pa.array(np.diff(to)), pa.array(np.diff(top[to])), pa.array(np.diff(total[to])), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A link is a pair of tokens that end together, one for each group. Its count is how often its ids are linked in all rows; it is a best one
    if no id of A is linked with its id of B more often. Texts are aligned once and their links stored; the counts, at most one for each
    possible pair of the two vocabularies, are added up by Spark and broadcast. Rows without tokens (see groups()) have zeros and ''."""
    spark = docs.sparkSession
    held = _tokenizers(docs, vocabulary, model)
    pairs = Tokenizers(*held.value).pairs
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with batches_of(spark, TOGETHER):
        stored = keep(rows.mapInArrow(_align(held, False), DIGEST), "links")
    sums = stored.select("links").mapInArrow(_count(len(pairs)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(pairs), np.int64)
    n[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    of_b = pairs & 0xFFFFFFFF
    most = np.zeros(int(of_b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, of_b, n)
    counts = spark.sparkContext.broadcast((n, n == most[of_b]))
    return stored.mapInArrow(_measure(counts), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
