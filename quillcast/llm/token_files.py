"""Token-ID output: documents in order of doc_id, as files of independent, checksummed range-coded blocks.

Documents are range-partitioned and sorted by doc_id. Each task encodes them with the tokenizers library and
packs whole documents into blocks of about BLOCK_IDS ids (a longer document is a block of its own), coded
by range_coder.py. The files are a Parquet table with a row for each block: part and block (their order),
first (ids of the part before the block), doc_ids, n_ids and payload; Spark's commit protocol keeps them
whole when executors are lost. Reading needs the payload alone for the ids; blocks decode independently.
"""

from __future__ import annotations

import os
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcast.llm.common import keep, shared_dir, table
from quillcast.llm.range_coder import TOGETHER, decode, encode
from quillcast.llm.text_arrays import slices, text_buffers

BLOCK_IDS = 1 << 17
END = 2
#: Stretches that a worker's cache keeps (about 40 bytes each), and how many the library gets as one text.
MOST_KEPT, TOGETHER_STRETCHES = 1 << 20, 2000
#: Bytes of text whose stretches are found at once.
SLICE_BYTES = 8 << 20
#: Characters that some Unicode versions count as white space: no stretch begins or ends with one.
ODD = "\u180e\u200b\u2060\ufeff"
#: What no text holds where it is cut fast, and texts that are cut slowly: with it, or with a blank beside anything but a plain character.
MARK = "\x00"
_WHITE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}"
ODD_BLANKS = f"\\x00|\\A |[{_WHITE}] | [{_WHITE}]| \\z"
#: A blank and Latin letters, and the signs after them.
WORD_AND_SIGNS = "^(?P<word> [A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}]+)(?P<signs>[\\x21-\\x26\\x28-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e]*)$"
SCHEMA = "part long, block long, first long, doc_ids array<long>, n_ids array<long>, payload binary"


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, as the library gives them with its defaults (a special token's string is that token).

    The byte-level pre-tokenizer always begins a new piece at a single blank between two characters that
    aren't white space, and nothing before such a place bears on what follows it. So a text is cut there, the
    different stretches of many texts are found at once, and the library encodes those that are new. The others
    come from a cache in Arrow and numpy: its stretches, the place of each one's ids, and when each was last met.
    With MOST_KEPT stretches it holds about 40 MB, and the half that was not met for longest goes."""

    def __init__(self, source: str, most_kept: int = MOST_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.blank = np.zeros(self.size, bool)
        self.blank[[k for t, k in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.most_kept, self.tick = most_kept, 0
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int64)

    def _runs(self, stretches: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of different stretches. With `joined` each is a blank and characters that are
        not white space; many are encoded as one text, and the ids that begin with a blank part them again."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(stretches), TOGETHER_STRETCHES):
            part = stretches[k : k + TOGETHER_STRETCHES]
            if not joined:
                for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                    ids.append(np.array(e.ids, np.uint32))
                    sizes.append(np.array([len(ids[-1])]))
                continue
            ids.append(np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32))
            at = np.flatnonzero(self.blank[ids[-1]])
            if len(at) != len(part):
                raise ValueError("the ids of joined stretches can't be parted")
            sizes.append(np.diff(np.append(at, len(ids[-1]))))
        return np.concatenate(ids), np.concatenate(sizes)

    def _library(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of different stretches that aren't in the cache.

        Letters, and the signs that may follow them, are pieces of their own: both are encoded once."""
        word = pc.extract_regex(fresh, WORD_AND_SIGNS)
        is_word = word.is_valid().to_numpy(zero_copy_only=False)
        word, others = word.drop_null(), fresh.filter(pa.array(~is_word)).to_pylist()
        # The blank is part of the word; a word that is in the cache isn't encoded again.
        heads, signs = (pc.struct_field(word, [k]).cast(pa.large_string()).dictionary_encode() for k in (0, 1))
        held = pc.index_in(heads.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(held < 0)
        plain = np.array([s[:1] == " " and s.split() == [s[1:]] and not any(x in s for x in self.special) and (s.isascii() or not any(c in s for c in ODD)) for s in others], bool)
        runs = [
            self._runs(heads.dictionary.take(pa.array(new)).to_pylist(), True), self._runs(signs.dictionary.to_pylist(), False),
            self._runs([s for s, p in zip(others, plain) if p], True), self._runs([s for s, p in zip(others, plain) if not p], False),
        ]
        ids = np.concatenate([self.ids, *(r[0] for r in runs)])
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([r[1] for r in runs]))])
        first = len(self.met) + np.append(0, np.cumsum([len(r[1]) for r in runs]))
        held[new] = first[0] + np.arange(len(new))
        # Two runs for each stretch; the second of all but words is empty.
        which = np.full((len(fresh), 2), len(ends) - 1, np.int64)
        ends = np.append(ends, ends[-1])
        which[is_word] = np.column_stack([held[heads.indices.to_numpy()], first[1] + signs.indices.to_numpy()])
        rest = np.flatnonzero(~is_word)
        which[rest[plain], 0], which[rest[~plain], 0] = first[2] + np.arange(int(plain.sum())), first[3] + np.arange(int((~plain).sum()))
        out, size = gather(ids, ends, which.reshape(-1))
        return out, size.reshape(-1, 2).sum(axis=1)

    @staticmethod
    def stretches(text: str) -> list[str]:
        """The text cut before the blanks that always begin a piece."""
        out: list[str] = []
        spaced = True  # whether what came before ends in white space (or nothing came before)
        for k, part in enumerate(text.split(" ")):
            blank = not part or part[0].isspace() or part[0] in ODD
            if k == 0:
                out.append(part)
            elif spaced or blank:
                out[-1] += " " + part
            else:
                out.append(" " + part)
            spaced = not part or part[-1].isspace() or part[-1] in ODD
        return out

    @staticmethod
    def _cut(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All stretches of the texts of a column, and where each text's begin."""
        # A mark before each blank: the parts keep their blanks. Texts that hold the mark, or white space at a
        # blank or another blank, are cut one by one.
        odd = pc.match_substring_regex(col, ODD_BLANKS)
        safe = pc.if_else(odd, "", col)
        parts = pc.split_pattern(pc.replace_substring(safe, " ", MARK + " "), MARK)
        values, ends = parts.flatten(), np.frombuffer(parts.buffers()[1], np.int64 if pa.types.is_large_list(parts.type) else np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
        ends = ends - ends[0]
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(at):
            return values, ends
        own = [Encoder.stretches(col[k].as_py()) for k in at.tolist()]
        counts = np.diff(ends)
        # One empty part stands in for each odd text: in its place come the text's stretches.
        extra = pa.array([s for x in own for s in x], values.type)
        n_own = np.array([len(x) for x in own], np.int64)
        own_begin = np.cumsum(n_own) - n_own
        begin = ends[:-1].copy()
        begin[at], counts[at] = len(values) + own_begin, n_own
        first = np.cumsum(counts) - counts
        take = np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(first, counts) + np.repeat(begin, counts)
        return pa.concat_arrays([values, extra]).take(pa.array(take)), np.append(first, int(counts.sum()))

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a column one after the other, number of ids of each); a null is an empty text."""
        col = col.fill_null("").cast(pa.large_string())
        values, ends = self._cut(col)
        coded = values.dictionary_encode()
        different, index = coded.dictionary, coded.indices.to_numpy()
        at = pc.index_in(different, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = different.take(pa.array(new))
            ids, size = self._library(fresh)
            at[new] = len(self.met) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, ids])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.tick += 1
        self.met[at] = self.tick
        which = at[index]
        out, size = gather(self.ids, self.ends, which)
        total = np.append(0, np.cumsum(size))
        if len(self.met) > self.most_kept:
            self._forget()
        return out, np.diff(total[ends])

    def _forget(self) -> None:
        """Keep the later half of the cache by when each stretch was met."""
        keep = np.sort(np.argsort(self.met, kind="stable")[-(self.most_kept // 2) :])
        self.ids, size = gather(self.ids, self.ends, keep)
        self.ends, self.met = np.append(0, np.cumsum(size)), self.met[keep]
        self.known = self.known.take(pa.array(keep))


def gather(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids named by `which`, one after the other, and their sizes."""
    begin, size = ends[which], ends[which + 1] - ends[which]
    first = np.cumsum(size) - size
    return ids[np.arange(int(size.sum())) + np.repeat(begin - first, size)], size


def _worker(source: str) -> Encoder:
    """The encoder of this worker process; kept from task to task, with its bounded cache."""
    state = sys.modules.setdefault("quillcast_worker", types.ModuleType("quillcast_worker"))
    held = getattr(state, "encoder", None)
    if held is None or held[0] != hash(source):
        state.encoder = held = (hash(source), Encoder(source))
    return held[1]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts one after the other, each followed by `end`, and their numbers."""
    counts = counts + 1
    last = np.cumsum(counts) - 1
    own = np.ones(int(counts.sum()), bool)
    own[last] = False
    out = np.full(len(own), end, np.uint32)
    out[own] = ids
    return out, counts


def _write(held, end: int, block_ids: int):
    def run(batches):
        encoder = _worker(held.value)
        size = max(encoder.size, end + 1)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        blocks: list[tuple[list, list, list]] = []
        docs: list = []
        counts: list[int] = []
        ids: list[np.ndarray] = []
        held_ids = 0

        def pack() -> None:
            nonlocal ids, docs, counts, held_ids
            if docs:
                blocks.append((docs, counts, ids))
            ids, docs, counts, held_ids = [], [], [], 0

        def flush():
            nonlocal block, before
            coded = encode([np.concatenate(b[2]) for b in blocks], size)
            rows = {"part": [], "block": [], "first": [], "doc_ids": [], "n_ids": [], "payload": coded}
            for d, n, _ in blocks:
                for k, v in (("part", part), ("block", block), ("first", before), ("doc_ids", d), ("n_ids", n)):
                    rows[k].append(v)
                block += 1
                before += sum(n)
            blocks.clear()
            kinds = {"doc_ids": pa.list_(pa.int64()), "n_ids": pa.list_(pa.int64()), "payload": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()], names=list(rows))

        for batch in batches:
            col = batch.column(1)
            for lo, hi in slices(text_buffers(col)[1], SLICE_BYTES):
                every, sizes = with_end(*encoder.encode(col.slice(lo, hi - lo)), end)
                at = 0
                for doc, n in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), sizes.tolist()):
                    if held_ids and held_ids + n > block_ids:
                        pack()
                        if len(blocks) >= TOGETHER:
                            yield flush()
                    ids.append(every[at : at + n])
                    docs.append(doc)
                    counts.append(n)
                    held_ids += n
                    at += n
        pack()
        if blocks:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Write docs(doc_id, text) to `path` in order of doc_id (null first), ids of each text and then `end`.

    A null or empty text has the id `end` only. Rows that share a doc_id are ordered by a hash of the text.
    No documents give a table without blocks."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:  # on the driver; a few MB at most
        held = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows.mapInArrow(_write(held, end, block_ids), SCHEMA).write.parquet(path)


def _read(batches):
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for at in range(0, len(batch), TOGETHER):
            c = {k: v.slice(at, TOGETHER) for k, v in columns.items()}
            out: dict[str, list] = {"part": [], "doc_id": [], "first": [], "n_tokens": [], "ids_crc32": []}
            decoded = decode([p.as_buffer().to_pybytes() for p in c["payload"]])
            for part, first, docs, counts, ids in zip(c["part"].to_pylist(), c["first"].to_pylist(), c["doc_ids"].to_pylist(), c["n_ids"].to_pylist(), decoded):
                if sum(counts) != len(ids):
                    raise ValueError("a block of token ids has another number of ids than its documents")
                data, k = memoryview(ids.astype("<u4").tobytes()), 0
                for doc, n in zip(docs, counts):
                    out["part"].append(part)
                    out["doc_id"].append(doc)
                    out["first"].append(first + k)
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(zlib.crc32(data[4 * k : 4 * (k + n)]))
                    k += n
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files at `path`; every checksum is verified.

    start adds the ids of the parts before, one row for each part, to the place within the part."""
    files = spark.read.schema(SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = keep(parts.select(F.col("part").alias("_part"), before.alias("before")), "parts")
    found = files.select("part", "first", "doc_ids", "n_ids", "payload").mapInArrow(_read, "part long, doc_id long, first long, n_tokens long, ids_crc32 long")
    return found.join(parts, F.col("part") == F.col("_part")).select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs to a new folder beside the checkpoints and read the files back."""
    path = f"{shared_dir(docs.sparkSession)}/quillcast-{uuid.uuid4().hex}/tokens"
    write_tokens(docs, path, vocabulary or vocabulary_file())
    return read_tokens(docs.sparkSession, path)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents").select("doc_id", "text"))
