"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Targets: the sources' weights share the words of all documents; a source gives at most `epochs` times its
own words, and what is over goes to the others by weight (in closed form, over one row per source).
Schedule: 2 ** m slots, for blocks of a 2 ** -m of all words (to one word). Slot n asks the n-th van der Corput point which source it takes from:
the one in whose stretch of the cumulative targets the point lies. So the points decide how many slots a source
has (its target / block, to one slot) and every stretch of the schedule has each source in proportion.
Slots are ranked within their source; rank k takes the k-th block of the source's shuffled
stream of documents (repeated for each epoch, and not beyond the last), and documents join by (source, block).

A block has about the cube root of all words: the slots, and with them the joins, grow less than the
words do, and the one slot by which a source can miss its target becomes ever smaller beside it.
Ranks and running word counts are kept in two levels (buckets of a hash or of slot numbers, then within
a bucket), so that a source with a third of all rows is dealt over thousands of groups. Joins with tables that
grow with the input are merge joins: nothing but the row a source is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcast.llm.common import WS, keep, prefix_sums, table

#: Buckets (as bits) within a source, and cells of the schedule that are made together.
BITS = 12
CHUNK = 4096


def n_words(text: str) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"[{WS}]+"))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """One row per source of sized(source, size): sid, source, source_size, target, bits and all (the schedule has
    2 ** bits slots for `all` words), first and slots (the source's stretch of the points, in units of 2 ** -bits), and
    take (the whole words that its slots can take).

    Sources take `weights` in turn by code point, null last. A source without words has target 0."""
    # Windows without a partition: this table has a row for each source, and no more.
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long"))
    per = per.withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    # The level at which the sources from this one on, by ratio, share what those before leave.
    per = per.withColumn("level", (F.sum("source_size").over(every) - sums("cap", before)) / (F.sum("w").over(every) - sums("w", before)))
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    per = per.withColumn("target", F.least("cap", F.col("level") * F.col("w")))
    # Cumulative targets in whole words, so that every engine draws the same bounds.
    per = per.withColumn("whole", F.least(F.round("target").cast("long"), F.col("source_size") * epochs))
    per = per.withColumn("upto", F.sum("whole").over(Window.orderBy("sid"))).withColumn("all", F.sum("whole").over(every))
    per = per.withColumn("bits", F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.col("all"), F.lit(1)).cast("double")) * F.lit(2 / 3)).cast("int")))
    # The points lie on the grid of 2 ** -bits: a stretch [a, b) of the cumulative targets has those from ceil(a) to ceil(b) - 1 in its units.
    per = per.withColumn("cells", F.pow(F.lit(2.0), F.col("bits")).cast("decimal(17,0)"))
    edge = lambda c: F.expr(f"coalesce((CAST(`{c}` AS DECIMAL(20,0)) * cells + `all` - 1) div nullif(CAST(`all` AS DECIMAL(20,0)), 0), 0L)")
    per = per.withColumn("from", F.col("upto") - F.col("whole")).withColumn("first", edge("from")).withColumn("slots", edge("upto") - F.col("first"))
    take = F.least(_times("slots", "all", "cells"), F.col("source_size") * epochs)
    return per.select("sid", "source", "source_size", "target", "bits", F.col("cells").cast("long").alias("cells"), "all", "first", "slots", take.alias("take"))


def _times(x: str, by: str, over: str, less: int = 0) -> Column:
    """(x * by - less) div over, in whole numbers of 38 digits."""
    return F.expr(f"(CAST({x} AS DECIMAL(20,0)) * CAST(`{by}` AS DECIMAL(17,0)) - {less}) div CAST(`{over}` AS DECIMAL(20,0))")


def schedule(targets: DataFrame) -> DataFrame:
    """(sid, k, slot): the slot of the schedule that takes the k-th block of a source.

    Slot n has the n-th van der Corput point, whose cell is n with its bits reversed; so the slots of a source
    are the reversed cells of its stretch. Cells are cut into chunks, and made where the chunk was dealt to."""
    bits = targets.agg(F.max("bits")).first()[0] or 1
    chunks = targets.filter("slots > 0").select("sid", "first", "slots", F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("first") + F.col("slots") - 1) / CHUNK))).alias("chunk"))
    chunks = chunks.repartition("sid", "chunk")
    cells = chunks.select("sid", F.explode(F.sequence(F.greatest("first", F.col("chunk") * CHUNK), F.least(F.col("first") + F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("cell"))
    slot = F.conv(F.reverse(F.lpad(F.bin("cell"), bits, "0")), 2, 10).cast("long")
    slots = cells.select("sid", slot.alias("slot"))
    slots = slots.withColumn("bucket", F.shiftright("slot", max(0, bits - BITS))).withColumn("one", F.lit(1).cast("long"))
    ranks = slots.join(prefix_sums(slots, ["sid"], "bucket", "one").hint("merge"), ["sid", "bucket"])
    k = F.col("before_one") + F.row_number().over(Window.partitionBy("sid", "bucket").orderBy("slot")) - 1
    return ranks.select("sid", k.alias("k"), "slot")


def shuffled(sized: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """sized with sid, take, cells, all, source_size and off, the words before a document in its source's shuffled stream."""
    # md5 orders documents alike on every engine; ties of whole rows are interchangeable.
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))
    rows = sized.join(targets.select("sid", F.col("source").alias("_s"), "source_size", "take", "cells", "all"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("h", h).withColumn("bucket", F.conv(F.substring("h", 1, BITS // 4), 16, 10).cast("long"))
    rows = rows.join(prefix_sums(rows, ["sid"], "bucket", "size").hint("merge"), ["sid", "bucket"])
    within = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("off", F.col("before_size") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("h", "bucket", "before_size")


def mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(pieces, targets) for a stored table sized(rid, doc_id, source, size).

    pieces has rid, slot, epoch, at (first word within the document) and words, in the order of the mix by
    slot. An empty table gives no pieces; a document without words has none; a null source is a source of
    its own; repeated rows are documents of their own; reruns agree."""
    targets = keep(source_targets(sized, weights, epochs), "targets")
    slots = schedule(targets)
    rows = shuffled(sized.filter("size > 0"), targets).filter("take > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("take") - 1) / F.col("source_size")))))
    rows = rows.withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("off"))
    rows = rows.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("take"))).filter("begin < end")
    # Block k has the words from (k * all) div cells on, so word p is in block ((p + 1) * cells - 1) div all.
    rows = rows.withColumn("k", F.explode(F.sequence(_times("begin + 1", "cells", "all", 1), _times("`end`", "cells", "all", 1))))
    low, high = F.greatest("begin", _times("k", "all", "cells")), F.least("end", _times("k + 1", "all", "cells"))
    rows = rows.select("rid", "sid", "k", "epoch", (low - F.col("begin")).alias("at"), (high - low).alias("words"))
    return rows.join(slots.hint("merge"), ["sid", "k"]).select("rid", "slot", "epoch", "at", "words"), targets


def size_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, text) as a stored table (rid, doc_id, source, size)."""
    return keep(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "source", n_words("text").alias("size")), "sized")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their own columns, in the order of the schedule: each as often as the mix takes its
    words, to the nearest whole number (only where a source's slots end is a document taken in part), and each
    copy at the slot that takes its first words. Documents without words are not in the mix. Any columns may be there."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "source", n_words("text").alias("size"), F.struct(*docs.columns).alias("row"))
    rows = keep(rows, "rows")
    pieces, _ = mix(rows.select("rid", "doc_id", "source", "size"))
    copies = pieces.groupBy("rid", "epoch").agg(F.sum("words").alias("words"), F.min_by("slot", "at").alias("slot"))
    chosen = rows.select("rid", "size", "row").join(copies.hint("merge"), "rid").filter("2 * words >= size")
    return chosen.repartitionByRange("slot", "rid").sortWithinPartitions("slot", "rid").select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = size_documents(table(spark, sf_dir, "documents"))
    pieces, targets = mix(sized)
    taken = pieces.groupBy("rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))
    rows = sized.join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return rows.join(taken.hint("merge"), "rid", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"),
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
w AS (SELECT *, (sid - 1) % 3 + 1.0::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM r),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT sid, source, source_size, least(cap, w * max(CASE WHEN level <= cap / w THEN level END) OVER ()) AS target FROM l),
u AS (SELECT *, least(CAST(round(target) AS BIGINT), source_size * 3) AS whole FROM t),
n AS (SELECT greatest(1, CAST(ceil(log2(greatest(sum(whole), 1)::DOUBLE) * (2.0::DOUBLE / 3)) AS INT)) AS bits, CAST(sum(whole) AS BIGINT) AS total FROM u),
v AS (SELECT sid, CAST(sum(whole) OVER (ORDER BY sid) AS BIGINT) AS upto, whole FROM u),
z AS (SELECT (1::BIGINT << bits) AS cells, bits, total FROM n),
p AS (SELECT i AS slot, CAST(list_sum(list_transform(range(bits), lambda j: ((i >> j) & 1) << (bits - 1 - j))) AS HUGEINT) * total AS point, cells, total FROM z, unnest(range(cells)) AS q(i)),
h AS (SELECT sid, slot, cells, total, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS k FROM p JOIN v ON point >= CAST(upto - whole AS HUGEINT) * cells AND point < CAST(upto AS HUGEINT) * cells),
b AS (SELECT sid, any_value(cells) AS cells, any_value(total) AS total, least(CAST(count(*)::HUGEINT * any_value(total) // any_value(cells) AS BIGINT), any_value(3 * source_size)) AS take FROM h JOIN u USING (sid) GROUP BY sid),
o AS (SELECT rid, sid, size, source_size, take, cells, total, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix'), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN b USING (sid)),
e AS (SELECT rid, sid, cells, total, CAST(off + epoch * source_size AS BIGINT) AS lo, CAST(least(off + epoch * source_size + size, take) AS BIGINT) AS hi FROM o, unnest([0, 1, 2]) AS x(epoch) WHERE size > 0 AND off + epoch * source_size < take),
c AS (SELECT rid, sid, cells, total, lo, hi, unnest(range(CAST(((lo + 1)::HUGEINT * cells - 1) // total AS BIGINT), CAST((hi::HUGEINT * cells - 1) // total AS BIGINT) + 1)) AS k FROM e),
g AS (SELECT rid, CAST(sum(least(hi, (c.k + 1)::HUGEINT * c.total // c.cells) - greatest(lo, c.k::HUGEINT * c.total // c.cells)) AS BIGINT) AS taken, min(slot) AS first_slot, count(DISTINCT slot) AS n_slots FROM c JOIN h ON h.sid = c.sid AND h.k = c.k GROUP BY rid)
SELECT d.doc_id, d.size, u.source_size, u.target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN g USING (rid)
"""
