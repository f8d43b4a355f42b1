"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.llm.common import keep


def _point(edges: DataFrame, both: bool) -> DataFrame:
    """One star step over (a, b), a > b: the neighbours of each node are linked to its smallest one.

    The smallest neighbours are written to a table first: then the join has an exchange on either side,
    and Spark can split the partition of a node with very many links."""
    sides = edges.select("a", "b")
    if both:
        sides = sides.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = keep(sides.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
    moved = sides.filter("b > a") if both else sides
    moved = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not both:
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return keep(moved.filter("a > b").distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link in edges (a, b); root is the smallest reachable node.

    Each round halves the depth of the trees at least, so the number of rounds is the logarithm of the
    longest chain. No links give an empty table; links of a node to itself and repeated ones do nothing."""
    edges = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        edges = _point(_point(edges, both=True), both=False)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
