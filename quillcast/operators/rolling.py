"""Rolling and latest-N means of the columns that a log has: over a whole log, over chunks of it, or batch after batch from stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, STATE, LATE = "rows", "state", "late"


def _means(columns: list[str], w, n: int) -> list[Column]:
    return [F.avg(c).over(w.rowsBetween(-(n - 1), 0)).alias(f"{c}_roll_avg") for c in columns]


def rolling_means(log: DataFrame, entity: str, order: list[str], columns: list[str], n: int = 5) -> DataFrame:
    """log with <column>_roll_avg for each column it has: the mean of the last n rows, nulls ignored."""
    w = Window.partitionBy(entity).orderBy(*order)
    return log.select(*log.columns, *_means([c for c in columns if c in log.columns], w, n))


def rolling_means_chunked(log: DataFrame, entity: str, order: list[str], columns: list[str], chunk: Column, n: int = 5) -> DataFrame:
    """rolling_means for logs in which few entities have most rows: an entity's rows are sorted by chunk, not all together.

    `chunk` must not fall as `order` rises (a month of the date, say). The last n - 1 rows of each chunk are all that later ones
    can need; of these tails, n - 1 for each chunk, every chunk takes those just before it. `order` should be total."""
    columns = [c for c in columns if c in log.columns]
    need = list(dict.fromkeys([entity, *order, *columns]))
    rows = log.withColumn("_chunk", chunk)
    back = Window.partitionBy(entity, "_chunk").orderBy(*(F.desc(o) for o in order))
    tails = rows.select(*need, "_chunk").withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= max(n - 1, 1))
    # In front of the first of a chunk's tail stand the tails of earlier chunks.
    w = Window.partitionBy(entity).orderBy(*order)
    before = F.collect_list(F.struct(*need)).over(w.rowsBetween(-(n - 1), -1)) if n > 1 else F.array().cast(f"array<{tails.select(F.struct(*need)).schema[0].dataType.simpleString()}>")
    seen = F.row_number().over(Window.partitionBy(entity, "_chunk").orderBy(*order))
    carried = tails.select("_chunk", before.alias("_before"), seen.alias("_first")).filter("_first = 1").select("_chunk", F.explode("_before").alias("_b")).select("_chunk", "_b.*")
    both = rows.withColumn("_old", F.lit(False)).unionByName(carried.withColumn("_old", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(entity, "_chunk").orderBy(*order)
    return both.select(*log.columns, "_old", *_means(columns, w, n)).filter("NOT _old").drop("_old")


def latest_means(log: DataFrame, entity: str, order: list[str], columns: list[str], n: int = 5, suffix: str = "_roll_avg") -> DataFrame:
    """Per entity the means of its last n rows: the newest rows are ranked, then aggregated."""
    w = Window.partitionBy(entity).orderBy(*(F.desc(o) for o in order))
    last = log.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    return last.groupBy(entity).agg(*(F.avg(c).alias(f"{c}{suffix}") for c in columns if c in log.columns), F.count("*").alias("n_rows"))


def rolling_step(state: DataFrame | None, new: DataFrame, entity: str, order: list[str], columns: list[str], n: int = 5) -> DataFrame:
    """The rows of a batch with their rolling means, and the state for the next batch, told apart by the column `part`:

    - `rows`: rows of `new`, with <column>_roll_avg as rolling_means over everything so far gives them;
    - `state`: the last n rows of each entity so far, with their means, all that a next batch and latest_means need;
    - `late`: rows of `new` that are not behind the newest row of their entity in the state, as when a batch comes again. They have
      no means and change nothing; a log that should hold them is built anew.

    `state` is the `state` part of the step before (None for the first), with the columns of `new` (a column that either lacks is null). Entities that
    have no new rows stay in the state. A null entity is one entity; null is the lowest order. Cost: the batch and n rows an entity, in one shuffle."""
    columns = [c for c in columns if c in new.columns]
    added = [f"{c}_roll_avg" for c in columns]
    own = [c for c in new.columns if c not in (*added, "part")]
    both = new.select(*own, F.lit(False).alias("_old"))
    if state is not None:
        both = both.unionByName(state.drop(*added, "part").withColumn("_old", F.lit(True)), allowMissingColumns=True)
    at = F.struct(*order)
    newest = F.max(F.when(F.col("_old"), at)).over(Window.partitionBy(entity))
    both = both.withColumn("_late", ~F.col("_old") & F.coalesce(at <= newest, F.lit(False)))
    w = Window.partitionBy(entity, "_late").orderBy(*order)
    back = F.row_number().over(Window.partitionBy(entity, "_late").orderBy(*(F.desc(o) for o in order)))
    out = both.select("*", *_means(columns, w, n), back.alias("_back"))
    parts = F.filter(
        F.array(F.when(F.col("_late"), LATE), F.when(~F.col("_late") & ~F.col("_old"), ROWS), F.when(~F.col("_late") & (F.col("_back") <= n), STATE)),
        lambda p: p.isNotNull(),
    )
    out = out.withColumn("part", F.explode(parts))
    kept = [c for c in out.columns if c not in (*added, "_old", "_late", "_back", "part")]
    return out.select(*kept, *(F.when(~F.col("_late"), F.col(a)).alias(a) for a in added), "part")
