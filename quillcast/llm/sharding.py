"""Sharding by Karmarkar-Karp differencing: equal texts stay together, bytes come out near equal.

Documents are first added up by text (a digest), so a group of copies of any size is one item. Items are
dealt by hash into cells of about `fan` items. In each cell the items start as partial partitions, one
filled part and the rest empty; again and again the two partial partitions with the largest spread are
combined, the fullest parts of one with the emptiest of the other, until one is left. The partial
partitions of the cells are the items of the next level, and so on to a single one. Every task and the
last step thus handle a bounded number of items at any number of documents, and the map from an item to
its shard is a chain of equi-joins from the last level back.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcast.llm.common import keep, prefix_sums, table

FAN = 1024
SLOT_BUCKETS = 4096


def difference(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions sizes[item, part] into one: (totals by part, part of the result for each item and part).

    Parts are ordered by total, smallest first. Ties go by the order of items, so the result is repeatable."""
    n, parts = sizes.shape
    order = np.argsort(sizes, axis=1, kind="stable")
    # A node is a list of totals by part; where[k] says which part of its node holds part k of an item.
    heap = [(-int(s[-1] - s[0]), k) for k, s in enumerate(np.take_along_axis(sizes, order, 1))]
    totals = {k: np.sort(sizes[k]).tolist() for k in range(n)}
    heapq.heapify(heap)
    joins, new = [], n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = [x + y for x, y in zip(totals.pop(a), reversed(totals.pop(b)))]
        rank = sorted(range(parts), key=both.__getitem__)
        totals[new] = [both[k] for k in rank]
        joins.append((a, b, rank))
        heapq.heappush(heap, (totals[new][0] - totals[new][-1], new))
        new += 1
    place = {new - 1: list(range(parts))}
    for k in range(len(joins) - 1, -1, -1):
        a, b, rank = joins[k]
        up = place.pop(n + k)
        to = [0] * parts
        for at, old in enumerate(rank):
            to[old] = up[at]
        place[a], place[b] = to, to[::-1]
    final = np.empty((n, parts), np.int64)
    for k in range(n):
        final[k, order[k]] = place[k]
    return np.array(totals[new - 1], np.int64), final


def _combine(parts: int):
    def run(key, t):
        t = t.sort_by([("item", "ascending")])
        sizes = np.array(t.column("sizes").to_pylist(), np.int64)
        if sizes.shape[1] < parts:
            sizes = np.pad(sizes, ((0, 0), (parts - sizes.shape[1], 0)))
        totals, place = difference(sizes)
        # Items of the first level fill their last part only.
        return pa.Table.from_arrays(
            [t.column("item"), pa.array([key[0].as_py()] * len(t), pa.int64()), pa.array(place.tolist(), pa.list_(pa.int64())), pa.array([totals.tolist()] * len(t), pa.list_(pa.int64()))],
            names=["item", "cell", "place", "totals"],
        )

    return run


def assign(items: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """(item, shard) for a stored table items(item, size long) with different items of any type that can be ordered.

    Cells and ties go by the items themselves, so the result doesn't depend on partitions. No items give no rows."""
    level = items.select("item", F.array("size").alias("sizes"))
    n, levels = items.count(), []
    while True:
        cells = max(1, -(-n // fan))
        cell = F.pmod(F.xxhash64("item"), F.lit(cells)) if cells > 1 else F.lit(0).cast("long")
        done = level.withColumn("cell", cell).groupBy("cell").applyInArrow(_combine(parts), f"item {level.schema['item'].dataType.simpleString()}, cell long, place array<long>, totals array<long>")
        done = keep(done, "level")
        levels.append(done.select("item", "cell", "place"))
        if cells == 1:
            break
        level = keep(done.select(F.col("cell").alias("item"), F.col("totals").alias("sizes")).dropDuplicates(["item"]), "cells")
        n = level.count()
    # From the last level back: which shard each part of a cell went to.
    to = levels[-1].select("item", F.col("place").alias("shards"))
    for done in reversed(levels[:-1]):
        upper = to.select(F.col("item").alias("cell"), F.col("shards").alias("up"))
        to = done.join(upper, "cell").select("item", F.transform("place", lambda p: F.get("up", p.cast("int"))).alias("shards"))
    return to.select("item", F.get("shards", F.size("shards") - 1).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs(doc_id, text), by the law `bytes`.

    size is the UTF-8 bytes of the text (null: none) plus 1; rows with equal texts (null like empty) share a
    shard, so one group of copies may alone be larger than a shard's share. slot counts the rows of a shard
    from 0 without gaps, by a hash of doc_id. Groups are numbered by the digest of their text, so the shards are the
    same however the rows are partitioned. Repeated rows and null ids get slots of their own."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(text, 256)
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(digest).alias("digest"))
    rows = keep(rows, "rows")
    groups = keep(rows.groupBy(F.col("digest").alias("item")).agg(F.sum("size").alias("size")), "groups")
    placed = keep(assign(groups, shards).select(F.col("item").alias("digest"), "shard"), "placed")
    dealt = rows.join(placed, "digest").withColumn("h", F.xxhash64("doc_id", F.lit("slot")))
    dealt = keep(dealt.select("doc_id", "size", "text_crc32", "shard", "h").withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(SLOT_BUCKETS)).cast("long")).withColumn("one", F.lit(1).cast("long")), "dealt")
    before = keep(prefix_sums(dealt, ["shard"], "bucket", "one"), "before")
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "text_crc32")) - 1
    return dealt.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before_one") + rank).alias("slot"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
