"""Benchmark decontamination with suffix arrays of the training text.

Each slice of a batch of documents is one shard. Its words become ids of the benchmark's vocabulary (0 for any
other word), and the suffixes of all runs that are long enough for a window are sorted: by their first WINDOW words, and if any
window occurs, by doubling as far as the longest item reaches. Every test suffix (place in an item where a
window begins) is binary-searched in that suffix array: its window gives an interval of training suffixes, its whole a
place within the interval, between the two training suffixes with the longest matches. Every training suffix in an
interval then lies between two test suffixes in turn, one of which has the longest verbatim match that begins there. An interval has as many
rows as its window occurs, and a suffix is in one interval for each length of window, so all work is linear in the
words of the shard, but for the logarithm, whatever repeats. Nothing is shuffled.

The benchmark is the query set. Spark numbers its items into blocks of at most `block_words` words (one larger item
is a block of its own) and builds each block in a task; the blocks are stored in the shared folder. One block is
read and broadcast at a time and destroyed after its search, so workers and driver hold one block, whatever the size of the
benchmark. With one block the text is read once, and nothing is stored. With more, the text is read once too: the documents' words are
stored as hashes, each block is searched in them, and stores only what it found in the documents that it hit.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillcast.llm.common import keep, prefix_sums, table
from quillcast.llm.text_arrays import ALNUM, FAR, LOWER, mix, slices, text_buffers, word_bounds, word_hashes

WINDOW = 10
BLOCK_WORDS = 1 << 19
#: Words that are compared at once where a match is lengthened; then follow single words.
STRIDE = 32


def suffix_array(words: np.ndarray) -> np.ndarray:
    """The places of all suffixes in order; 0 ends a suffix. By doubling of the sorted prefix."""
    n, size = len(words), 1
    rank = words.copy()
    while True:
        after = np.zeros(n, np.int64)
        if size < n:
            after[:-size] = rank[size:] + 1
        after[rank == 0] = 0
        key = rank * (n + int(rank.max(initial=0)) + 2) + after
        _, new = np.unique(key, return_inverse=True)
        # Ended suffixes stay at 0 and all alike.
        new = np.where(words == 0, 0, new + 1)
        if size >= n or len(np.unique(new)) == len(np.unique(rank)):
            return np.argsort(new, kind="stable")
        rank, size = new, size * 2


def strides(words: np.ndarray, end: int) -> np.ndarray:
    """A 64-bit hash of the next STRIDE words from each place; `end` sets apart where a text ends (the word 0)."""
    h = mix(np.where(words == 0, np.uint64((1 << 60) + end), words.astype(np.uint64)) + FAR)
    size = 1
    while size < STRIDE:
        after = np.full(len(h), end, np.uint64)
        after[:-size] = h[size:]
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + after)
        size *= 2
    return h


def make_block(ids: list[str], texts: list[str], window: int) -> dict:
    """A block of items: vocabulary, word ids with zeros after each item, its suffix array, and its different windows
    with the sets of items that hold them."""
    data, offs = text_buffers(pa.array(texts, pa.large_string()))
    starts, ends, first = word_bounds(LOWER[data], offs, ALNUM)
    hashes = word_hashes(LOWER[data], starts, ends)
    vocabulary, words = np.unique(hashes, return_inverse=True)
    sizes = np.diff(first)
    item_of = np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(words)) + item_of * window
    spaced = np.zeros(len(words) + (len(ids) + 1) * window, np.int64)
    spaced[place] = words + 1
    length = np.minimum(sizes, window)[item_of]
    begins = np.arange(len(words)) - first[:-1][item_of] + length <= sizes[item_of]
    at, length, item = place[begins], length[begins], item_of[begins]
    rows = np.zeros((len(at), window), np.int32)
    for k in range(window):
        rows[:, k] = np.where(k < length, spaced[at + k], 0)
    _, once, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    pair = np.unique(np.column_stack([which.reshape(-1), item]), axis=0)
    bounds = np.searchsorted(pair[:, 0], np.arange(len(once) + 1))
    sets: dict[bytes, int] = {}
    members, holder = [], np.zeros(len(once), np.int64)
    for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        own = pair[a:b, 1]
        holder[k] = sets.setdefault(own.tobytes(), len(sets))
        if holder[k] == len(members):
            members.append(own)
    seen = np.zeros(1 << 16, bool)  # the low bits of the vocabulary's hashes
    seen[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    item_at = np.zeros(len(spaced), np.int64)
    item_at[place] = item_of
    window_at = np.full(len(spaced), -1)
    window_at[at] = np.where(length == window, which.reshape(-1), -1)
    tests = suffix_array(spaced)
    tests = tests[window_at[tests] >= 0]  # so the numbers of their windows don't fall
    return {
        "ids": ids, "vocabulary": vocabulary, "seen": seen, "window": window, "words": spaced, "item": item_at, "strides": strides(spaced, 1), "tests": tests, "tests_window": window_at[tests], "longest": int(sizes.max(initial=0)),
        "at": at[once], "length": length[once], "holder": holder, "members": members,
    }


def _build(window: int):
    def run(key, t):
        t = t.sort_by([("i", "ascending"), ("t", "ascending")])
        block = make_block(t.column("i").to_pylist(), t.column("t").to_pylist(), window)
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([pickle.dumps(block)], pa.binary())], names=["block", "data"])

    return run


def benchmark_blocks(items: DataFrame, window: int, block_words: int) -> DataFrame:
    """A stored table (block, data) of the items' blocks. Equal items are one."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    rows = rows.withColumn("n", F.size(F.split("t", "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")).cast("long"))
    rows = keep(rows.withColumn("bucket", F.pmod(F.xxhash64("i", "t"), F.lit(4096))).withColumn("one", F.lit(1)), "items")
    # A block ends where the words so far pass a multiple of block_words; a bucket's items are in one block or follow each other.
    before = prefix_sums(rows, ["one"], "bucket", "n")
    block = F.floor(F.col("before_n") / block_words)
    within = F.sum("n").over(_in_bucket())
    rows = rows.join(F.broadcast(before), ["one", "bucket"]).withColumn("block", F.struct(block.alias("b"), F.floor((within - 1) / block_words).alias("c")))
    rows = rows.select("i", "t", F.xxhash64("block").alias("block"))
    return keep(rows.groupBy("block").applyInArrow(_build(window), "block long, data binary"), "blocks")


def _in_bucket():
    from pyspark.sql import Window

    return Window.partitionBy("bucket").orderBy("i", "t").rowsBetween(Window.unboundedPreceding, 0)


def _bisect(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """The first place in each [lo, hi) whose key is not below (with `right`: above) the value."""
    lo, hi = lo.copy(), hi.copy()
    go = np.flatnonzero(lo < hi)
    while len(go):
        mid = (lo[go] + hi[go]) >> 1
        up = keys[mid] <= value[go] if right else keys[mid] < value[go]
        lo[go] = np.where(up, mid + 1, lo[go])
        hi[go] = np.where(up, hi[go], mid)
        go = go[lo[go] < hi[go]]
    return lo


def common_words(words: np.ndarray, far: np.ndarray, a: np.ndarray, block: dict, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many words are alike at the shard's places a and the benchmark's places b, of which `size` are known to be."""
    size = size.copy()
    on = np.arange(len(a))
    while len(on):
        on = on[far[a[on] + size[on]] == block["strides"][b[on] + size[on]]]
        size[on] += STRIDE
    on = np.arange(len(a))
    while len(on):
        w = words[a[on] + size[on]]
        on = on[(w > 0) & (w == block["words"][b[on] + size[on]])]
        size[on] += 1
    return size


def sort_on(words: np.ndarray, suffix: np.ndarray, keys: list[np.ndarray], window: int, longest: int) -> np.ndarray:
    """Places that are sorted by their first `window` words (with the keys of these), sorted by more than `longest` words.

    The places are all those of some runs of words; the word 0 ends a suffix."""
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)) if len(suffix) else np.zeros(0, bool)
    rank, ends = np.cumsum(new), np.flatnonzero(words == 0)
    left = ends[np.searchsorted(ends, suffix)] - suffix
    at, size = np.zeros(len(words), np.int64), window
    while size <= longest and len(rank) and rank.max() < len(rank):
        at[suffix] = rank
        goes_on = left > size
        after = np.where(goes_on, at[np.where(goes_on, suffix + size, 0)], 0)
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1] + 1
        size *= 2
    return suffix[np.argsort(rank, kind="stable")]


def longest_matches(words: np.ndarray, suffix: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a shard's suffix array and the intervals [lo, hi) of the different windows `which` (all of full length, rising): numbers of the suffixes in any
    interval, the words of the longest match that begins there, and its place in the benchmark.

    Every test suffix with one of these windows is binary-searched in its interval."""
    far = strides(words, 2)
    first, last = np.searchsorted(block["tests_window"], which, "left"), np.searchsorted(block["tests_window"], which, "right")
    number = last - first
    tests = block["tests"][np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)]
    # The number of training suffixes that are not above each test suffix.
    below, above = np.repeat(lo, number), np.repeat(hi, number)
    low = np.full(len(tests), block["window"])
    high = low.copy()
    go = np.flatnonzero(below < above)
    while len(go):
        mid = (below[go] + above[go]) >> 1
        size = common_words(words, far, suffix[mid], block, tests[go], np.minimum(low[go], high[go]))
        up = words[suffix[mid] + size] <= block["words"][tests[go] + size]
        below[go], low[go] = np.where(up, mid + 1, below[go]), np.where(up, size, low[go])
        above[go], high[go] = np.where(up, above[go], mid), np.where(up, high[go], size)
        go = go[below[go] < above[go]]
    counts = hi - lo
    hit = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
    next_test = np.searchsorted(below, hit, "right")
    none = np.zeros(len(hit), np.int64)
    before, behind = tests[np.maximum(next_test - 1, 0)], tests[np.minimum(next_test, len(tests) - 1)]
    a, b = (common_words(words, far, suffix[hit], block, t, none) for t in (before, behind))
    return hit, np.maximum(a, b), np.where(a >= b, before, behind)


def search(hashes: np.ndarray, first: np.ndarray, block: dict) -> tuple[np.ndarray, ...]:
    """All matches of different windows in one shard: (window, word number in the shard, document, words of the longest match with any item that
    begins there, its item); the last two are 0 where no window of full length begins. No word begins more than one match of each length."""
    window, vocabulary, none = block["window"], block["vocabulary"], np.zeros(0, np.int64)
    maybe = np.flatnonzero(block["seen"][(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    if not len(maybe) or not len(block["at"]):
        return none, none, none, none, none
    near = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    same = vocabulary[near] == hashes[maybe]
    places = maybe[same]
    doc = np.searchsorted(first, places, "right") - 1
    words = np.zeros(len(hashes) + window * (len(first) + 1), np.int64)
    suffix = places + doc * window
    words[suffix] = near[same] + 1
    # Only runs of as many of the benchmark's words as the shortest window has can hold a match.
    full = words > 0
    run = full.copy()
    least = int(block["length"].min())
    for k in range(1, least):
        run[:-k] &= full[k:]
    held = run.copy()
    for k in range(1, least):
        held[k:] |= run[:-k]
    able = held[suffix]
    suffix = suffix[able]
    bits = int(len(vocabulary) + 1).bit_length()
    packed = max(1, 62 // bits)
    keys = []
    for k in range(0, window, packed):
        key = np.zeros(len(suffix), np.int64)
        for j in range(k, k + packed):
            key = (key << bits) | (words[suffix + j] if j < window else 0)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    suffix, keys = suffix[order], [k[order] for k in keys]
    which = np.arange(len(block["at"]))
    lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(suffix), np.int64)
    for k, key in enumerate(keys):
        low = np.zeros(len(which), np.int64)
        high = low.copy()
        for j in range(k * packed, (k + 1) * packed):
            inside = j < block["length"][which]
            word = np.where(inside, block["words"][block["at"][which] + min(j, window - 1)], 0)
            low = (low << bits) | word
            high = (high << bits) | np.where(inside, word, (1 << bits) - 1)
        if k:
            lo, hi = _bisect(key, lo, hi, low, False), _bisect(key, lo, hi, high, True)
        else:
            lo, hi = np.searchsorted(key, low, "left"), np.searchsorted(key, high, "right")
        found = np.flatnonzero(hi > lo)
        which, lo, hi = which[found], lo[found], hi[found]
    longest, item = np.zeros(len(suffix), np.int64), np.zeros(len(suffix), np.int64)
    whole = block["length"][which] == window
    if whole.any():
        suffix = sort_on(words, suffix, keys, window, block["longest"])
        hit, size, test = longest_matches(words, suffix, lo[whole], hi[whole], which[whole], block)
        longest[hit], item[hit] = size, block["item"][test]
    counts = hi - lo
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
    # A document's words and its gap are the places before the next one's.
    doc = np.searchsorted(first + np.arange(len(first)) * window, suffix[at], "right") - 1
    return np.repeat(which, counts), suffix[at] - doc * window, doc, longest[at], item[at]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Sorted, disjoint [start, end) ranges of the n words that any of the ranges covers."""
    step = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    on = np.concatenate([[False], np.cumsum(step) > 0])
    return np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)


def _hash(batches):
    """The column _text as the hashes of its words, 8 bytes each."""
    for batch in batches:
        names = batch.schema.names
        for lo, hi in slices(text_buffers(batch.column(names.index("_text")))[1]):
            part = batch.slice(lo, hi - lo)
            data, offs = text_buffers(part.column(names.index("_text")))
            starts, ends, first = word_bounds(LOWER[data], offs, ALNUM)
            hashes = word_hashes(LOWER[data], starts, ends).tobytes()
            sizes = np.diff(first)
            out = {"_hashes": pa.array([hashes[8 * a : 8 * b] for a, b in zip(first.tolist(), first[1:].tolist())], pa.binary()), "_words": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([out.get(c, part.column(k)) for k, c in enumerate(names)], names=names)


def _shards(batch):
    """(rows, hashes of all their words, number of each row's first word with the total last): slices of bounded size."""
    names = batch.schema.names
    if "_hashes" in names:
        data = batch.column(names.index("_hashes"))
        sizes = np.array([len(x) // 8 for x in data.to_pylist()], np.int64)
        for lo, hi in slices(np.append(0, np.cumsum(sizes * 8))):
            yield batch.slice(lo, hi - lo), np.frombuffer(b"".join(data.slice(lo, hi - lo).to_pylist()), np.uint64), np.append(0, np.cumsum(sizes[lo:hi]))
        return
    text = names.index("_text")
    for lo, hi in slices(text_buffers(batch.column(text))[1]):
        part = batch.slice(lo, hi - lo)
        data, offs = text_buffers(part.column(text))
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offs, ALNUM)
        yield part, word_hashes(data, starts, ends), first


def _pass(held):
    def run(batches):
        block = held.value
        window = block["window"]
        for batch in batches:
            names = batch.schema.names
            for part, hashes, first in _shards(batch):
                which, where, doc, longest, test_item = search(hashes, first[:-1], block)
                out = {c: part.column(names.index(c)).to_pylist() for c in ("_hits", "_items", "_longest")}
                if len(which):
                    length = block["length"][which]
                    # One row for each word that begins a match, with its longest window.
                    o = np.lexsort((-length, where))
                    o = o[np.append(True, np.diff(where[o]) != 0)]
                    place, size, own = where[o], length[o], doc[o]
                    match, item = longest[o], test_item[o].copy()
                    short = match < window
                    size_of = np.where(short, size, match)
                    short_item = np.array([block["members"][k][0] for k in block["holder"][which[o][short]]], np.int64)
                    item[short] = short_item
                    best = np.lexsort((place, -size_of, own))
                    best = best[np.append(True, np.diff(own[best]) != 0)]
                    for k in best.tolist():
                        d = int(own[k])
                        out["_longest"][d] = {"words": int(size_of[k]), "at": int(place[k] - first[d]), "item": block["ids"][item[k]]}
                    cover = covered(place, place + size, int(first[-1]))
                    # A window doesn't reach into the next document, but the covers of two may touch: they are cut there.
                    cuts = np.unique(first[1:-1])
                    inner = cuts[(np.searchsorted(cover[:, 0], cuts, "left") > 0) & (cover[np.searchsorted(cover[:, 0], cuts, "left") - 1, 1] > cuts)]
                    edges = np.sort(np.concatenate([cover.reshape(-1), inner, inner])).reshape(-1, 2)
                    in_doc = np.searchsorted(first, edges[:, 0], "right") - 1
                    for d in np.unique(in_doc).tolist():
                        a, b = np.searchsorted(in_doc, [d, d + 1])
                        r = (edges[a:b] - first[d]).reshape(-1)
                        out["_hits"][d] = r.tolist()
                    pair = np.unique(np.column_stack([doc, block["holder"][which]]), axis=0)
                    bound = np.searchsorted(pair[:, 0], np.unique(pair[:, 0]))
                    for a, b in zip(bound.tolist(), [*bound[1:].tolist(), len(pair)]):
                        d = int(pair[a, 0])
                        members = np.unique(np.concatenate([block["members"][k] for k in pair[a:b, 1]]))
                        out["_items"][d] = sorted({block["ids"][k] for k in members})
                arrays = []
                for field in batch.schema:
                    if field.name == "_words":
                        arrays.append(pa.array(np.diff(first), pa.int64()))
                    elif field.name in out:
                        arrays.append(pa.array(out[field.name], field.type))
                    elif field.name == "_hashes":
                        arrays.append(pa.nulls(len(part), field.type))
                    else:
                        arrays.append(part.column(names.index(field.name)))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = True) -> DataFrame:
    """Columns of `docs` (text on request) and n_words, n_hit, items (sorted ids, as strings), longest
    (words, at, item: the longest verbatim match of at least one window, or null), contaminated.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased; an item with fewer words
    than `window` is one window. Null or empty texts have no words and no hits; an item without words
    matches nothing; a null item id counts as ''. Repeated items are listed once by id. Columns of `docs`
    with one of the names above are replaced. With no items nothing is contaminated. Nothing is dropped."""
    new = ["n_words", "n_hit", "items", "longest", "contaminated"]
    own = [c for c in docs.columns if c not in new and c != "text"]
    spark = docs.sparkSession
    empty = T.StructType([T.StructField("words", T.LongType()), T.StructField("at", T.LongType()), T.StructField("item", T.StringType())])
    none = [F.array().cast("array<long>").alias("_hits"), F.array().cast("array<string>").alias("_items"), F.lit(None).cast(empty).alias("_longest")]
    base = [F.struct(*own).alias("_own") if own else F.lit(None).cast("string").alias("_own"), F.col("text").alias("_text"), F.lit(0).cast("long").alias("_words")]
    blocks = benchmark_blocks(items, window, block_words)
    names = [r["block"] for r in blocks.select("block").orderBy("block").collect()]  # a number for each block

    def block_of(name: int | None) -> dict:
        return make_block([], [], window) if name is None else pickle.loads(blocks.filter(F.col("block") == name).first()["data"])

    def loose(df: DataFrame) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])

    if len(names) < 2:
        df = docs.select(*base, *none)
        df = df.mapInArrow(_pass(spark.sparkContext.broadcast(block_of(names[0] if names else None))), loose(df)).withColumn("_ranges", ranges("_hits"))
    else:
        df = docs.select(*base, F.monotonically_increasing_id().alias("_id"), F.lit(None).cast("binary").alias("_hashes"))
        df = keep(df.mapInArrow(_hash, loose(df)) if keep_text else df.mapInArrow(_hash, loose(df)).withColumn("_text", F.lit(None).cast("string")), "hashes")
        found = []
        for name in names:
            held = spark.sparkContext.broadcast(block_of(name))
            part = df.select("_id", "_hashes", F.lit(0).cast("long").alias("_words"), *none)
            found.append(keep(part.mapInArrow(_pass(held), loose(part)).filter(F.size("_hits") > 0).select("_id", ranges("_hits").alias("_ranges"), "_items", "_longest"), "found"))
            held.destroy()
        every = reduce(DataFrame.union, found).groupBy("_id").agg(
            F.flatten(F.collect_list("_ranges")).alias("_ranges"), F.flatten(F.collect_list("_items")).alias("_items"),
            F.max_by("_longest", F.struct(F.col("_longest.words"), -F.col("_longest.at"), F.col("_longest.item"))).alias("_longest"),
        )
        df = df.drop("_hashes").join(every, "_id", "left").withColumn("_ranges", F.coalesce("_ranges", ranges(F.array().cast("array<long>"))))
        df = df.withColumn("_items", F.coalesce(F.array_sort(F.array_distinct("_items")), F.array().cast("array<string>")))
    # Ranges of different blocks may overlap: a word counts once.
    total = F.aggregate(
        F.array_sort("_ranges"), F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, r: F.struct(F.greatest(a["end"], r["e"]).alias("end"), (a["n"] + F.greatest(r["e"] - F.greatest(a["end"], r["s"]), F.lit(0).cast("long"))).alias("n")),
    )
    return df.select(
        *(F.col("_own")[c].alias(c) for c in own), *([F.col("_text").alias("text")] if keep_text else []), F.col("_words").alias("n_words"), total["n"].alias("n_hit"),
        F.col("_items").alias("items"), F.col("_longest").alias("longest"), (F.size("_ranges") > 0).alias("contaminated"),
    )


def ranges(flat: Column | str) -> Column:
    """[s, e, s, e, ...] as an array of (s, e)."""
    flat = F.col(flat) if isinstance(flat, str) else flat
    return F.transform(F.filter(flat, lambda _, i: i % 2 == 0), lambda s, i: F.struct(s.alias("s"), F.get(flat, 2 * i + 1).alias("e")))


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    found = find_leaks(docs.select(F.struct(*docs.columns).alias("row"), "text"), items, window, keep_text=False)
    return found.filter("NOT contaminated").select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated",
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
