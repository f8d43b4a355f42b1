"""Near duplicates: one-permutation hashing, banded buckets, star-shaped candidates, confirmed on full sets.

1. A document's set is that of its distinct n-word shingles (64-bit hashes). Documents with equal sets
   form one class at once, so copies never reach the buckets; from here on only classes are compared.
2. The one permutation is the shingle hash itself: its high bits name a bin, the smallest rest in a bin is
   the bin's value, and an empty bin takes that of the first non-empty bin on its own random walk
   (optimal densification). `bands` bands of `rows` bins make the bucket keys.
3. In each bucket only pairs with one centre are candidates; they are confirmed on the full sets. A second
   star with a random centre for each bucket follows where a bucket still holds several components.
4. A star can't see a link between two members that aren't linked with a centre. So each bucket that still
   holds several components is finished exactly: its members outside its largest component are compared
   with all of its members, in blocks of about 2 * `block_bytes` of sets (or of two sets, if one is larger).
   Pairs stay inside a task.
Components of the confirmed links are found with joins (components.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcast.llm.common import keep, sieve, sifted, table
from quillcast.llm.components import components
from quillcast.llm.text_arrays import LOWER, NOT_SPACE, mix, runs, slices, text_buffers, word_bounds, word_hashes

#: Bytes of the sets in one half of a block.
BLOCK_BYTES = 4 << 20
#: Documents without an id get a number from here on, by their text; it never leaves this module.
NO_ID = 1 << 62


def shingle_sets(col: pa.Array, n: int):
    """For each text of a column, its sorted distinct shingle hashes."""
    data, offs = text_buffers(col)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offs, NOT_SPACE)
    words = word_hashes(data, starts, ends)
    shingles = runs(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(shingles[a : b - n + 1])
        else:
            yield runs(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def walks(bins: int, steps: int) -> np.ndarray:
    """For each bin, the bins its random walk visits."""
    return np.random.Generator(np.random.PCG64(bins)).integers(0, bins, (steps, bins))


def band_keys(s: np.ndarray, bands: int, rows: int, walk: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Bucket keys of a non-empty set."""
    bins = bands * rows
    where = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.append(0, np.flatnonzero(np.diff(where)) + 1)  # s is sorted, so bins come in order with their least value first
    value = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    at = where[first].astype(np.int64)
    value[at], full[at] = s[first], True
    source = np.arange(bins)
    empty = np.flatnonzero(~full)
    for step in walk:
        if not len(empty):
            break
        source[empty] = step[empty]
        empty = empty[~full[source[empty]]]
    source[empty] = at[0]
    v = mix(value[source] + salt).reshape(bands, rows)
    key = v[:, 0].copy()
    for k in range(1, rows):
        key = mix(key * np.uint64(31) + v[:, k])
    return key


def _signatures(n: int, bands: int, rows: int):
    def run(batches):
        walk = walks(bands * rows, 64)
        salt = mix(np.arange(bands * rows, dtype=np.uint64))
        for batch in batches:
            col = batch.column(1)
            for lo, hi in slices(text_buffers(col)[1]):
                size, left, right, keys = [], [], [], []
                for s in shingle_sets(col.slice(lo, hi - lo), n):
                    size.append(len(s))
                    if len(s):
                        left.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                        right.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)))
                        keys.append(band_keys(s, bands, rows, walk, salt).view(np.int64))
                    else:
                        left.append(None)
                        right.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["row", "n", "f1", "f2", "keys"])

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            col = batch.column(1)
            for lo, hi in slices(text_buffers(col)[1]):
                sets = [s.tobytes() for s in shingle_sets(col.slice(lo, hi - lo), n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["node", "s"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y) or not len(x):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            last, held, ok = None, None, np.zeros(len(a), bool)
            for k, (i, p, q) in enumerate(zip(a.to_pylist(), x, y)):
                if i != last:
                    last, held = i, np.frombuffer(p.as_buffer(), np.uint64)
                ok[k] = similar(held, np.frombuffer(q.as_buffer(), np.uint64), percent)
            keep_rows = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(keep_rows), b.filter(keep_rows)], names=["a", "b"])

    return run


def block_links(nodes: np.ndarray, roots: np.ndarray, rows: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links in one block between members of different components: rows marked True against all.

    Two members in one component after a link found here are not compared again."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(np.concatenate(sets), kind="stable") if len(sets) else np.zeros(0, np.int64)
    every = np.concatenate(sets)[order]
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    shingle = np.cumsum(np.append(False, np.diff(every) != 0))
    # Shingles of one member only can't be shared.
    shared = np.bincount(shingle)[shingle] > 1
    owner, shingle = owner[shared], shingle[shared]
    begin = np.searchsorted(shingle, np.unique(shingle))
    count = np.diff(np.append(begin, len(shingle)))
    by_owner = np.argsort(owner, kind="stable")
    group = np.repeat(np.arange(len(begin)), count)[by_owner]
    at = np.searchsorted(owner[by_owner], np.arange(len(sets) + 1))
    roots, out = roots.copy(), []
    for i in np.flatnonzero(rows).tolist():
        g = group[at[i] : at[i + 1]]
        c = count[g]
        if not len(c):
            continue
        start = np.cumsum(c) - c
        both = np.bincount(owner[np.arange(int(c.sum())) - np.repeat(start, c) + np.repeat(begin[g], c)], minlength=len(sets))
        fits = (100 * both >= percent * (sizes[i] + sizes - both)) & (roots != roots[i])
        for j in np.flatnonzero(fits).tolist():
            if roots[j] != roots[i]:
                out.append((int(nodes[i]), int(nodes[j])))
                roots[roots == roots[j]] = roots[i]
    return out


def _finish(percent: int):
    def run(batches):
        held: list[tuple] = []

        def links():
            nodes, roots, rows = (np.array([r[k] for r in held]) for k in (1, 2, 3))
            return block_links(nodes, roots, rows.astype(bool), [np.frombuffer(r[4], np.uint64) for r in held], percent)

        for batch in batches:
            found = []
            for r in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held and held[0][0] != r[0]:
                    found += links()
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])
        if held:
            found = links()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of docs(doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased. A text with fewer words than `words` is one
    shingle; a null or empty text has none, is linked with nothing and kept. Links join texts with
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable. A row without
    doc_id takes part under a hidden number: its component_id is null if no row with an id is reachable,
    and it is kept only then. Rows that share a doc_id count as linked. Rows are never dropped."""
    node = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 3)).alias("node")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node, "text")
    seen = docs.select(F.struct("doc_id", "node", F.xxhash64("text").alias("text_hash")).alias("row"), "text")
    seen = keep(seen.mapInArrow(_signatures(words, bands, rows), "row struct<doc_id: long, node: long, text_hash: long>, n long, f1 long, f2 long, keys array<long>").select("row.*", "n", "f1", "f2", "keys"), "seen")
    classes = keep(seen.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("node").alias("rep"), F.first("keys").alias("keys")), "classes")
    member = classes.select("rep", "n", F.explode("keys").alias("key"))
    buckets = keep(member.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("centre")).filter("size > 1"), "buckets")
    member = keep(member.join(buckets, "key"), "member")
    # Sets of too different sizes can't be linked.
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    stars = keep(member.filter("rep <> centre.rep").filter(near(F.col("n"), F.col("centre.n"))).select(F.col("centre.rep").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    wanted = keep(member.select(F.col("rep").alias("node")).distinct(), "wanted")
    # Only the texts that the sieve lets through are shuffled to those that are wanted.
    able = sifted(docs.select("node", "text"), sieve(wanted, "node"), "node")
    sets = able.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(_sets(words), "node long, s binary")
    sets = keep(sets, "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
        return keep(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"), "links")

    def rooted(roots: DataFrame, members: DataFrame) -> DataFrame:
        return members.join(roots, members["rep"] == roots["node"], "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))

    def several(members: DataFrame) -> DataFrame:
        """Buckets with several components, with a random centre and the largest component."""
        by_root = members.groupBy("key", "root").agg(F.sum("n").alias("n"), F.min(F.struct(F.xxhash64("key", "rep"), "rep", F.col("n").alias("pick_n"))).alias("pick"))
        return by_root.groupBy("key").agg(
            F.count("*").alias("roots"), F.sum("n").alias("size"), F.max_by("root", "n").alias("main"), F.max("n").alias("main_size"),
            F.max_by(F.struct("pick.rep", "pick.pick_n", "root"), "n").alias("pick"),
        ).filter("roots > 1")

    links = confirm(stars)
    roots = keep(components(links), "roots")
    # Pairs are all known in buckets of two.
    open_ = keep(rooted(roots, member.filter("size > 2").select("key", "rep", "n")), "open")
    picks = keep(several(open_).select("key", "pick"), "picks")
    second = open_.join(picks, "key").filter("root <> pick.root").filter(near(F.col("n"), F.col("pick.pick_n"))).select(F.col("pick.rep").alias("a"), F.col("rep").alias("b")).distinct()
    more = confirm(second.join(stars, ["a", "b"], "left_anti"))
    roots = keep(components(links.union(more)), "roots")
    open_ = keep(rooted(roots, open_.select("key", "rep", "n")), "open")
    # Sizes are numbers of shingles of 8 bytes; the component of most of them is the main one.
    halves = lambda c: F.ceil(c * 8 / F.lit(block_bytes))
    left = keep(several(open_).withColumn("side_blocks", halves(F.col("size") - F.col("main_size"))).withColumn("main_blocks", halves(F.col("main_size"))).drop("pick"), "left")
    dealt = open_.join(left, "key").withColumn("side", F.col("root") != F.col("main"))
    own = F.when(F.col("side"), F.pmod(F.xxhash64("rep"), "side_blocks")).otherwise(F.pmod(F.xxhash64("rep"), "main_blocks"))
    dealt = dealt.withColumn("own", own)
    # A side member meets all side blocks and all main blocks; a main member meets all side blocks.
    with_side = F.transform(F.sequence(F.lit(0).cast("long"), F.col("side_blocks") - 1), lambda j: F.struct(F.when(F.col("side"), F.least("own", j)).otherwise(j).alias("i"), F.when(F.col("side"), F.greatest("own", j)).otherwise(F.col("own") + F.col("side_blocks")).alias("j")))
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("main_blocks") - 1), lambda j: F.struct(F.col("own").alias("i"), (j + F.col("side_blocks")).alias("j")))
    meets = dealt.select("key", "rep", "root", "side", F.explode(F.when(F.col("side"), F.concat(with_side, with_main)).otherwise(with_side)).alias("at"))
    meets = meets.select(F.xxhash64("key", "at.i", "at.j").alias("block"), "rep", "root", "side")
    blocks = meets.join(sets, meets["rep"] == sets["node"]).select("block", "rep", "root", "side", "s").repartition("block").sortWithinPartitions("block")
    rest = keep(blocks.mapInArrow(_finish(percent), "a long, b long"), "rest")
    if not rest.isEmpty():
        roots = keep(components(links.union(more).union(rest)), "roots")
    named = classes.select("f1", "f2", "n", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", F.coalesce("root", "rep").alias("root"))
    named = keep(named, "named")
    out = seen.select("doc_id", "node", "text_hash", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    root = F.coalesce("root", "node")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(root < NO_ID, root).alias("component_id"), (F.col("node") == root).alias("kept"), "text_hash",
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """One document of each group, with its own columns: that with the smallest doc_id.

    Of rows that agree in doc_id and text one stays, the first by its other columns as JSON. Documents without words
    all stay, one for each doc_id and text. Any other columns may be there, under any names."""
    found = near_duplicates(docs.select("doc_id", "text"), words, percent, bands, rows).filter("kept")
    found = found.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("row"))
    kept = named.join(found, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    rest = [c for c in docs.columns if c != "text"]
    first = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.to_json(F.struct(*(F.col("row")[c].alias(c) for c in rest)))))
    return kept.withColumn("n", first).filter("n = 1").select("row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85, bands=20, rows=5)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, min(root) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
