"""Ranked lexical search: the best documents for each item, by the Best Position Algorithm over impact lists.

Documents are indexed in chunks of bounded text. A chunk's index has one row for each term that items may ask
for (which documents hold it and how often) and one row with its documents and their lengths. Terms are looked
up behind a sieve of fixed size, then by an equi-join with the items' terms, so no vocabulary is broadcast.
Each chunk and block of items is searched in one task: a list for each term holds its documents by falling
impact, lists are read in growing steps from their best positions (all positions up to there are seen), and each
document met is looked up in all other lists, which moves their best positions on. No unseen document can score
more than the impacts after the best positions together; a chunk is done when that bound is strictly below its
50th best score. The best of all chunks are then ranked for each item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcast.llm.chunks import chunks, hashed_words
from quillcast.llm.common import keep, table
from quillcast.llm.text_arrays import ALNUM

TOP = 50
#: Weight 1000 times a logarithm; saturation and length parameters of the score, in whole numbers.
SCALE, ROUGH, FIRST_STEP = 1000, 50, 64
#: (item, term) pairs of a block of items, and bits of the sieve of terms.
BLOCK_PAIRS, SIEVE_BITS = 1 << 18, 22
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "chunk long, term string, docs binary, amounts binary, ids array<long>, n_docs long, n_terms long"


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term), different pairs. Rows with the same item_id, null too, are one item."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER_CASE), F.lit(TERM), F.lit(0))
    return items.select(F.col(item).alias("item_id"), F.explode(words).alias("term")).distinct()


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    for batch in batches:
        for *_, hashes, _ in hashed_words(batch.column(0), ALNUM):
            at = hashes >> np.uint64(64 - SIEVE_BITS)
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["at", "bits"])


def term_sieve(terms: DataFrame) -> np.ndarray:
    """A bit for the hash of each term. What reaches the driver are 2^16 numbers at most, for any number of terms."""
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    for r in terms.mapInArrow(_bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect():
        out[r["at"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _index(sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sieve.value
        for number, parts in chunks(batches, 1):
            base, docs, hashes, lengths, spelled = 0, [], [], [], {}
            for part in parts:
                for lo, hi, data, starts, ends, h, n in hashed_words(part.column(1), ALNUM):
                    own = np.flatnonzero(wanted[(h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
                    docs.append((base + np.repeat(np.arange(hi - lo), n))[own])
                    hashes.append(h[own])
                    lengths.append(n)
                    for v, k in zip(*(x.tolist() for x in np.unique(h[own], return_index=True))):
                        if v not in spelled:
                            spelled[v] = data[starts[own[k]] : ends[own[k]]].tobytes().decode()
                    base += hi - lo
            n, h, d = np.concatenate(lengths), np.concatenate(hashes), np.concatenate(docs)
            yield _row(number, None, None, n, pa.concat_arrays([p.column(0) for p in parts]), int((n > 0).sum()), int(n.sum()))
            order = np.argsort(h, kind="stable")  # documents stay in order
            h, d = h[order], d[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, np.int64)
            h, d, tf = h[first], d[first].astype(np.int32), np.diff(np.append(first, len(h)))
            cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(h)).tolist()):
                yield _row(number, spelled[int(h[a])], d[a:b], tf[a:b], None, b - a, int(tf[a:b].sum()))

    return run


def _row(chunk: int, term: str | None, docs: np.ndarray | None, amounts: np.ndarray, ids: pa.Array | None, n_docs: int, n_terms: int) -> pa.RecordBatch:
    ids = pa.array([ids.cast(pa.int64()).to_pylist() if ids is not None else None], pa.list_(pa.int64()))
    values = [pa.array([chunk]), pa.array([term], pa.string()), pa.array([None if docs is None else docs.astype(np.int32).tobytes()], pa.binary()), pa.array([amounts.astype(np.int32).tobytes()], pa.binary()), ids, pa.array([n_docs]), pa.array([n_terms])]
    return pa.RecordBatch.from_arrays(values, names=["chunk", "term", "docs", "amounts", "ids", "n_docs", "n_terms"])


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index of docs(doc_id, text) for the terms that the sieve lets pass; a row without a term has a chunk's documents."""
    sieve = docs.sparkSession.sparkContext.broadcast(term_sieve(terms.select("term").distinct()))
    return keep(docs.select("doc_id", "text").mapInArrow(_index(sieve), INDEX), "index")


class ImpactList:
    """The documents of a term by falling impact, and where each document stands."""

    def __init__(self, docs: np.ndarray, impact: np.ndarray):
        order = np.lexsort((docs, -impact))
        self.docs, self.impact, self.by_doc = docs[order], impact[order], docs
        self.place = np.empty(len(docs), np.int64)
        self.place[order] = np.arange(len(docs))

    def look_up(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of docs are in the list, their positions)."""
        at = np.searchsorted(self.by_doc, docs)
        at[at == len(self.by_doc)] = 0
        found = np.flatnonzero(self.by_doc[at] == docs)
        return found, self.place[at[found]]


def best_positions(lists: list[ImpactList], n_docs: int, top: int = TOP, first_step: int = FIRST_STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, positions read) with at least all documents that can be among the best `top`, ties with the last included."""
    score, met = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    seen = [np.zeros(len(x.docs) + 1, bool) for x in lists]
    best, step, read = [0] * len(lists), first_step, 0
    while True:
        ahead = [x.docs[b : b + step] for x, b in zip(lists, best)]
        read += sum(map(len, ahead))
        new = np.unique(np.concatenate(ahead))
        new = new[~met[new]]
        met[new] = True
        for k, x in enumerate(lists):  # direct accesses
            found, place = x.look_up(new)
            score[new[found]] += x.impact[place]
            seen[k][place] = True
            best[k] += int(np.argmin(seen[k][best[k] :]))
        bound = sum(int(x.impact[b]) for x, b in zip(lists, best) if b < len(x.docs))
        if not any(b < len(x.docs) for x, b in zip(lists, best)):
            break
        own = score[met]
        if len(own) >= top and bound < np.partition(own, len(own) - top)[len(own) - top]:
            break
        step *= 2
    docs = np.flatnonzero(met)
    return docs, score[docs], read


def _search(all_docs: int, all_terms: int, top: int, kind: pa.DataType):
    def run(group: pa.Table) -> pa.Table:
        head = group.filter(group.column("term").is_null())
        ids = head.column("ids").combine_chunks().flatten() if len(head) else pa.array([], pa.int64())
        n = np.frombuffer(head.column("amounts")[0].as_py(), np.int32).astype(np.int64) if len(head) else np.zeros(0, np.int64)
        m = 100 - ROUGH + (ROUGH * n * all_docs) // max(all_terms, 1)
        group = group.filter(group.column("term").is_valid())
        lists, asked = [], {}
        for k, (w, d, tf, items) in enumerate(zip(*(group.column(c).to_pylist() for c in ("weight", "docs", "amounts", "items")))):
            d, tf = np.frombuffer(d, np.int32).astype(np.int64), np.frombuffer(tf, np.int32).astype(np.int64)
            lists.append(ImpactList(d, w * ((1_000_000_000 * tf) // (SCALE * tf + 20 * m[d]))))
            for i in items:
                asked.setdefault(i["item_id"], []).append(k)
        # A null doc_id counts as the lowest.
        known, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        items, found, scores = [], [], []
        for i, own in asked.items():
            docs, score, _ = best_positions([lists[k] for k in own], len(n), top)
            able = score > 0
            docs, score = docs[able], score[able]
            first = np.lexsort((number[docs], known[docs], -score))[:top]
            items += [i] * len(first)
            found.append(docs[first])
            scores.append(score[first])
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(items, kind), ids.take(pa.array(at)), pa.array(np.concatenate(scores) if scores else np.zeros(0, np.int64))], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of items(item_id, text) the `top` best rows of docs(doc_id, text) with a score above 0.

    Equal scores rank by ascending doc_id, a null first; rows that share a doc_id are documents of their own. Null and empty texts have no
    terms and are never found; items without a term that some document holds have no rows. Other columns are ignored."""
    spark = docs.sparkSession
    terms = keep(item_terms(items), "item_terms")
    index = build_index(docs, terms)
    total = index.filter("term IS NULL").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("t")).first()
    blocks = max(1, -(-terms.count() // BLOCK_PAIRS))
    held = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(SCALE * F.log((2 * F.lit(total["d"]) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighted = held.select("term", weight.alias("weight")).filter("weight > 0")
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")
    asked = terms.join(weighted, "term").groupBy("term", "weight", block).agg(F.collect_list(F.struct("item_id")).alias("items"))  # a null counts too; of one block: bounded by BLOCK_PAIRS
    kind = terms.schema["item_id"].dataType
    rows = index.filter("term IS NOT NULL").join(asked, "term").select("chunk", "block", "term", "docs", "amounts", F.lit(None).cast("array<long>").alias("ids"), "weight", "items")
    heads = index.filter("term IS NULL").select("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(None).cast("string").alias("term"), "docs", "amounts", "ids", F.lit(0).cast("long").alias("weight"), F.lit(None).cast(rows.schema["items"].dataType).alias("items"))
    from pyspark.sql.pandas.types import to_arrow_type

    found = rows.unionByName(heads).groupBy("chunk", "block").applyInArrow(_search(total["d"], total["t"], top, to_arrow_type(kind)), f"item_id {kind.simpleString()}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, g GROUP BY term, nd),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * nd) // l AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
