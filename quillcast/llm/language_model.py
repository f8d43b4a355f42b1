"""Language-model scores of whole documents: a gated recurrent network over frequent words, word counts over the whole corpus for the others.

Words are counted over all training documents. Each chunk of documents writes its texts as numbers in its own word list; the lists meet the
counts by word, and come back to their chunk, so that a word is shuffled once for each chunk and texts are numbered without a
corpus-wide vocabulary in any task. The most frequent words have numbers of the network (gru.py); all others
are one symbol there, times their share by counts among these others (a word never seen has a share too), so the
probabilities of all words and of the end add up to 1. The network starts with the counts' own predictions. In each round every trainer, a group of
training documents, continues from the same parameters, and Spark averages what they return, weighted by words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm import gru
from quillcast.llm.chunks import chunks, hashed_words
from quillcast.llm.common import discard, keep, table
from quillcast.llm.text_arrays import NOT_SPACE, slices

#: Training words that the network sees in every round: this many and this share of the corpus (by hash of documents); all others it sees in one round.
LEAST_WORDS, SHARE = 2_000_000, 1 / 32
#: Rounds, words of a trainer, and averages that reach the driver (2 MB each).
ROUNDS, TRAINER_WORDS, FAN_IN = 3, 2_000_000, 4
#: Bytes of word numbers (two each) that are scored together.
TOGETHER_BYTES = 4 << 20
#: Bytes of a word's number in its chunk's list, little-endian.
NUMBER_BYTES = 3
NUMBERED = "chunk long, doc_id long, fold long, words binary, hashes array<long>, counts array<long>"
READY = "doc_id long, fold long, n_tokens long, n_known long, base_score double, rest_score double, words binary"


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 10


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary rows of `counts` values each."""
    offs = np.append(0, np.cumsum(counts)) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offs), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with return_inverse: only the different values are sorted."""
    coded = pa.array(hashes).dictionary_encode()
    different = coded.dictionary.to_numpy()
    order = np.argsort(different)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return different[order], rank[coded.indices.to_numpy()]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["chunk", "doc_id", "fold", "words", "hashes", "counts"]
    longs = pa.list_(pa.int64())
    for number, parts in chunks(batches, 2):
        hashes, sizes = [], []
        for part in parts:
            for *_, h, n in hashed_words(part.column(2), NOT_SPACE):
                hashes.append(h)
                sizes.append(n)
        n = np.concatenate(sizes)
        different, own = _distinct(np.concatenate(hashes))
        folds = pa.concat_arrays([p.column(1) for p in parts])
        learnt = folds.fill_null(0).to_numpy() != 0
        counts = np.bincount(own[np.repeat(learnt, n)], minlength=len(different))
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([different.view(np.int64)], longs), pa.array([counts], longs)], names=names)
        if len(different) >> (8 * NUMBER_BYTES):
            raise ValueError("a chunk has too many different words")
        short = np.ascontiguousarray(own.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :NUMBER_BYTES]).view(f"V{NUMBER_BYTES}").reshape(-1)
        ids = pa.concat_arrays([p.column(0) for p in parts])
        none = pa.nulls(len(n), longs)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number)), ids, folds, binary(short, n), none, none], names=names)


class Counts:
    """Word counts of the corpus: N, V, training documents, and the network's words (by hash) with their counts, most frequent first."""

    def __init__(self, words: int, different: int, docs: int, top: list[tuple[int, int]]):
        self.n, self.v, self.docs = words + docs, different + (docs > 0), docs
        hashes, counts = np.array([t[0] for t in top], np.int64), np.array([t[1] for t in top], np.int64)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order + 2
        # The other words' mass, with a share for words never seen.
        self.others = float(words - counts.sum()) + 0.1 * (different - len(top)) + 0.1
        self.start = np.concatenate([[docs + 0.1, self.others], counts + 0.1])

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


def _ready(held):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        k: Counts = held.value
        heads = left.filter(left.column("hashes").is_valid())
        docs = left.filter(left.column("hashes").is_null())
        hashes = np.array(heads.column("hashes")[0].values, np.int64) if len(heads) else np.zeros(0, np.int64)
        c = np.zeros(len(hashes) + 1, np.int64)
        c[right.column("pos").to_numpy()] = right.column("c").to_numpy()
        at = np.minimum(np.searchsorted(k.hashes, hashes), max(len(k.hashes) - 1, 0))
        number = np.full(len(hashes), gru.OTHER)
        if len(k.hashes):
            number = np.where(k.hashes[at] == hashes, k.number[at], gru.OTHER)
        base = k.base(c[:-1])
        rest = np.where(number == gru.OTHER, np.log10((c[:-1] + 0.1) / k.others), 0.0)
        words = docs.column("words").combine_chunks().cast(pa.large_binary())
        offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        own = np.zeros((int(offs[-1] - offs[0]) // NUMBER_BYTES, 4), np.uint8)
        if len(own):
            own[:, :NUMBER_BYTES] = np.frombuffer(words.buffers()[2], np.uint8, int(offs[-1] - offs[0]), int(offs[0])).reshape(-1, NUMBER_BYTES)
        own = own.view("<u4").reshape(-1).astype(np.int64)
        ends = (offs - offs[0]) // NUMBER_BYTES
        sums = lambda v: np.diff(np.append(0, np.cumsum(v[own]))[ends])
        n = np.diff(ends)
        symbols = np.full(len(own) + len(n), gru.END, np.uint16)
        inner = np.ones(len(symbols), bool)
        inner[ends[1:] + np.arange(len(n))] = False
        symbols[inner] = number[own]
        # Sums are of one text each, so that a text's score doesn't depend on its neighbours.
        by_text = lambda v: np.array([v[own[a:b]].sum() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], float)
        columns = [docs.column("doc_id").combine_chunks(), docs.column("fold").combine_chunks(), pa.array(n + 1), pa.array(sums((c[:-1] > 0).astype(np.int64)) + (k.docs > 0)), pa.array(by_text(base) + float(k.base(np.array(k.docs)))), pa.array(by_text(rest)), binary(symbols, n + 1)]
        return pa.Table.from_arrays(columns, names=["doc_id", "fold", "n_tokens", "n_known", "base_score", "rest_score", "words"])

    return run


def numbered(docs: DataFrame) -> tuple[DataFrame, Counts]:
    """(a stored table of docs(doc_id, text) as numbers of the network with what the counts say of each text, the counts)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold().cast("long").alias("fold"), "text")
    stored = keep(own.mapInArrow(_number, NUMBERED), "numbered")
    lists = stored.filter("hashes IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("hashes", "counts")).alias("pos", "x")).select("chunk", F.col("pos").cast("long").alias("pos"), F.col("x.hashes").alias("word"), F.col("x.counts").alias("n"))
    known = keep(lists.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "counts")
    total = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("*").alias("v")).first()
    learnt = stored.filter("words IS NOT NULL AND fold <> 0").count()
    top = known.orderBy(F.desc("c"), "word").limit(gru.SIZE**2 - 2).collect()
    counts = Counts(total["c"], total["v"], learnt, [(r["word"], r["c"]) for r in top])
    right = lists.join(known, "word").select(F.col("chunk").alias("of"), "pos", "c")
    held = docs.sparkSession.sparkContext.broadcast(counts)
    rows = stored.select("chunk", "doc_id", "fold", "words", "hashes").groupBy("chunk").cogroup(right.groupBy("of")).applyInArrow(_ready(held), READY)
    ready = keep(rows, "ready")
    for done in (stored, known):
        discard(done)
    return ready, counts


def _arrays(col: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in col]


def _lesson(held):
    def run(group: pa.Table) -> pa.Table:
        params, squares = held.value
        docs = [d for _, d in sorted(zip(group.column("h").to_pylist(), _arrays(group.column("words"))), key=lambda x: (x[0], x[1].tobytes()))]
        p, s, n = gru.train(gru.unpack(params), docs, scale=None if squares is None else gru.unpack(squares))
        return pa.Table.from_arrays([group.column("trainer").combine_chunks()[:1], pa.array([n]), pa.array([np.concatenate([gru.pack(p), gru.pack(s)]).tobytes()], pa.binary())], names=["trainer", "n", "mean"])

    return run


def _mean(rows: list[tuple[int, bytes]]) -> np.ndarray:
    """The mean of what trainers return, weighted by words."""
    total = np.zeros(len(rows[0][1]) // 4)
    for n, v in rows:
        total += n * np.frombuffer(v, np.float32).astype(float)
    return (total / sum(n for n, _ in rows)).astype(np.float32)


def _add(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("trainer")
    n = rows.column("n").to_pylist()
    return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([sum(n)]), pa.array([_mean(list(zip(n, rows.column("mean").to_pylist()))).tobytes()], pa.binary())], names=["trainer", "n", "mean"])


def fit(ready: DataFrame, counts: Counts, rounds: int = ROUNDS, least: int = LEAST_WORDS, share: float = SHARE, trainer_words: int = TRAINER_WORDS) -> gru.Params:
    """The network after `rounds` rounds over all training documents: those that a hash chooses, about `least` words and `share` of the corpus, are in every round,
    each other one is in one round."""
    params, squares = gru.pack(gru.start(counts.start)), None
    part = min(1.0, least / max(counts.n, 1) + share)
    h = F.xxhash64("doc_id", "words")
    learnt = ready.filter("fold <> 0").withColumn("h", h)
    always = F.pmod(F.col("h"), F.lit(1 << 20)) < math.ceil(part * (1 << 20))
    turn = F.pmod(F.xxhash64(F.lit("turn"), "h"), F.lit(max(rounds, 1)))
    trainers = max(1, math.ceil((part + (1 - part) / rounds) * counts.n / trainer_words))
    # Texts as numbers are stored already; a second table of them would be most of the corpus.
    lessons = learnt.select("h", "words", always.alias("always"), turn.alias("turn"), F.pmod(F.shiftright("h", 20), F.lit(trainers)).alias("trainer"))
    size = len(params)
    for k in range(rounds):
        held = ready.sparkSession.sparkContext.broadcast((params, squares))
        means, left = lessons.filter(F.col("always") | (F.col("turn") == k)).select("h", "words", "trainer").groupBy("trainer").applyInArrow(_lesson(held), "trainer long, n long, mean binary"), trainers
        while left > FAN_IN:
            left = -(-left // FAN_IN)
            means = means.groupBy((F.col("trainer") % left).alias("_to")).applyInArrow(_add, "trainer long, n long, mean binary")
        rows = sorted((r["trainer"], r["n"], bytes(r["mean"])) for r in means.collect())  # at most FAN_IN
        if not rows:
            break
        total = _mean([r[1:] for r in rows])
        params, squares = total[:size], total[size:]
        held.unpersist()
    return gru.unpack(params)


def _score(held, train_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = held.value
        for batch in batches:
            words = batch.column(6).cast(pa.large_binary())
            offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
            for lo, hi in slices(offs, TOGETHER_BYTES):
                rows = batch.slice(lo, hi - lo)
                log = gru.log_likelihoods(params, _arrays(rows.column(6))) / math.log(10)
                held_out = pa.array((rows.column(1).fill_null(1).to_numpy() == 0))
                rest = rows.column(5).to_numpy()
                yield pa.RecordBatch.from_arrays([rows.column(0), held_out, rows.column(2), rows.column(3), pa.array(np.full(len(rows), train_tokens)), rows.column(4), pa.array(log + rest)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, **more) -> DataFrame:
    """For each row of docs(doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score, logarithms to base 10.

    Texts are whole; a null is empty and has one token, its end. Documents whose crc32(doc_id as text) mod 10 is 0 are held out; a
    null doc_id is neither held out nor learnt from. Rows that share a doc_id are rows of their own, and count as often as they come; other columns are ignored. Without training
    documents every base_score is that of an unseen word. `more` goes to fit()."""
    ready, counts = numbered(docs)
    params = docs.sparkSession.sparkContext.broadcast(fit(ready, counts, **more))
    columns = READY.split(", ")
    return ready.select(*(c.split(" ")[0] for c in columns)).mapInArrow(_score(params, counts.n), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op12_score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
