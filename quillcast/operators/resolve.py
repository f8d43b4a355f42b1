"""Resolving names against a reference table, for all queries at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcast.functions.text import POSITIONS, normalize_name, primary_category
from quillcast.functions.values import first_present

#: The ten features of recent averages, and for each the columns that can give it, best first.
RECENT = {
    "pts_roll_avg": ["PTS"], "reb_roll_avg": ["REB"], "ast_roll_avg": ["AST"], "min_roll_avg": ["MIN"], "fga_roll_avg": ["FGA", "2PM"],
    "fg3a_roll_avg": ["3PA", "3PM"], "fta_roll_avg": ["FTA", "FTM"], "stl_roll_avg": ["STL"], "blk_roll_avg": ["BLK"], "tov_roll_avg": ["TO"],
}
#: The columns of a season-average row.
SEASON = ["PTS", "REB", "AST", "MIN", "FGA", "FG3A", "FTA", "STL", "BLK", "TOV"]


#: Characters of the stretches that needles of so many or more are looked up by. There are few trigrams, of digits a thousand: with names and needles
#: that end in numbers the pairs of equal trigrams would grow with the product of both.
LONG = 8


def _pieces(c: Column, size: int) -> Column:
    """The different stretches of `size` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1))), lambda i: F.substring(c, i, size)))


def containing(needles: DataFrame, names: DataFrame, needle: str = "needle", name: str = "name", short: bool | None = None) -> DataFrame:
    """Pairs (needle, name) of the different needles and names of two tables, where the name contains the needle literally.

    Names are found by equi-joins: each needle is looked up by that of its stretches of LONG characters which the fewest names have, so a
    common one is no hot key as long as a needle has a rarer one. Shorter needles are looked up by their trigrams, needles of one or two characters
    by themselves; names are cut that short only if `short`, by default if there are such needles. Empty needles match nothing."""
    return candidates(needles, names, needle, name, short).filter(F.contains("name", "needle"))


def candidates(needles: DataFrame, names: DataFrame, needle: str, name: str, short: bool | None = None) -> DataFrame:
    """The pairs that containing() looks at: those of a needle and a name with the needle's rarest stretch."""
    n = needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct()
    h = names.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct()
    if short is None:
        short = not n.filter(F.length("needle") < 3).isEmpty()
    sizes = [1, 2, 3, LONG] if short else [3, LONG]
    own = F.when(F.length("needle") >= LONG, _pieces(F.col("needle"), LONG)).when(F.length("needle") >= 3, _pieces(F.col("needle"), 3)).otherwise(F.array("needle"))
    grams = n.select("needle", F.explode(own).alias("gram"))
    wanted = grams.select("gram").distinct()
    pieces = h.select("name", F.explode(F.array_distinct(F.flatten(F.array(*(_pieces(F.col("name"), k) for k in sizes))))).alias("gram"))
    keyed = pieces.join(wanted, "gram", "left_semi")
    counted = keyed.groupBy("gram").agg(F.count("*").alias("n"))
    # A needle with a stretch that no name has matches nothing.
    rarest = grams.join(counted, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(keyed, "gram").select("needle", "name")


@dataclass
class Reference:
    """A table that names are looked up in: the column of its names, the column `order` of which the first row counts, and the tiers that apply."""

    table: DataFrame
    name: str
    order: str
    tiers: tuple[int, ...] = (1, 2, 3)


def resolve_in(queries: DataFrame, query: str, references: dict[str, Reference], skip: tuple[str, ...] = ()) -> DataFrame:
    """queries with a column for each reference: a struct of `tier` and `match` (its row), null without a match. Tiers are those of resolve().

    All references share one lookup: their different names make one index, which each needle asks once. For each needle and reference the
    first name is chosen before queries are joined, so a last word that many queries and many names share costs their sum, not their
    product. Orders are compared as they are and must have one type. Rows of a reference are joined last, by name."""
    q = queries.select(F.col(query).alias("_raw")).distinct().select("_raw", normalize_name(F.col("_raw")).alias("_q")).filter("_q <> ''")
    words = F.filter(F.split("_q", r"\s+"), lambda w: ~w.isin(*skip)) if skip else F.split("_q", r"\s+")
    needles = {1: F.col("_q"), 2: F.col("_q"), 3: F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))}
    tiers = sorted({t for r in references.values() for t in r.tiers})
    asked = q.select("_raw", F.explode(F.array(*(F.struct(F.lit(t).alias("_tier"), needles[t].alias("_needle")) for t in tiers))).alias("x")).select("_raw", "x.*").filter("_needle <> ''")
    rows = {k: r.table.select(normalize_name(F.col(r.name)).alias("_name"), F.struct(F.col(r.order).alias("o")).alias("_o"), F.struct(*r.table.columns).alias("_row")) for k, r in references.items()}
    # Of the rows that share a name only the first can match.
    names = reduce(DataFrame.unionByName, (r.groupBy("_name").agg(F.min("_o").alias("_o")).select(F.lit(k).alias("_in"), "_name", "_o") for k, r in rows.items()))
    found = asked.filter("_tier = 1").join(names, F.col("_needle") == F.col("_name")).select("_raw", "_tier", "_in", "_name", "_o")
    if max(tiers) > 1:
        pairs = containing(asked.filter("_tier > 1"), names, "_needle", "_name")
        first = pairs.join(names, F.col("name") == F.col("_name")).groupBy("needle", "_in").agg(F.min("_o").alias("_o"), F.min_by("_name", "_o").alias("_name"))
        found = found.unionByName(asked.filter("_tier > 1").join(first, F.col("_needle") == F.col("needle")).select("_raw", "_tier", "_in", "_name", "_o"))
    able = [(F.col("_in") == k) & F.col("_tier").isin(*r.tiers) for k, r in references.items()]
    best = found.filter(reduce(Column.__or__, able)).groupBy("_raw", "_in").agg(F.min_by(F.struct("_tier", "_name"), F.struct("_tier", "_o")).alias("_best"))
    wide = best.groupBy("_raw").agg(*(F.max(F.when(F.col("_in") == k, F.col("_best"))).alias(f"_b{i}") for i, k in enumerate(references)))
    own = [c for c in queries.columns if c not in references]
    out = queries.select(*own).join(wide, queries[query].eqNullSafe(F.col("_raw")), "left").drop("_raw")
    for i, (k, r) in enumerate(rows.items()):
        only = r.groupBy(F.col("_name").alias(f"_n{i}")).agg(F.min_by("_row", "_o").alias(f"_r{i}"))
        out = out.join(only, F.col(f"_b{i}._name") == F.col(f"_n{i}"), "left")
    return out.select(*own, *(F.when(F.col(f"_n{i}").isNotNull(), F.struct(F.col(f"_b{i}._tier").alias("tier"), F.col(f"_r{i}").alias("match"))).alias(k) for i, k in enumerate(references)))


def resolve(queries: DataFrame, ref: DataFrame, query: str, name: str, *order: str, tiers: tuple[int, ...] = (1, 2, 3), skip: tuple[str, ...] = ()) -> DataFrame:
    """queries with tier and match (a struct of ref's row, null without one).

    Tier 1: the normalised names are equal. Tier 2: the name contains the query. Tier 3: the name contains
    the query's last word, leaving out words in `skip` (suffixes such as JR.). The first row of ref in `order` wins
    within the lowest tier. A blank query matches nothing; names are literal text, not patterns."""
    one = ref.select("*", F.struct(*order).alias("_order"))
    found = resolve_in(queries, query, {"_found": Reference(one, name, "_order", tiers)}, skip)
    row = F.struct(*(F.col(f"_found.match.`{c}`").alias(c) for c in ref.columns))
    return found.select(*queries.columns, F.col("_found.tier").alias("tier"), F.when(F.col("_found").isNotNull(), row).alias("match"))


def value_of(match: str, value: str, ref: DataFrame, missing: float = 20.0, no_table: float = 25.0) -> Column:
    """`value` of a match's row; `missing` without one, `no_table` if ref is empty."""
    return F.coalesce(F.col(f"{match}.`{value}`").cast("double"), F.lit(no_table if ref.isEmpty() else missing))


def resolve_value(queries: DataFrame, ref: DataFrame, query: str, name: str, value: str, *order: str, missing: float = 20.0, no_table: float = 25.0) -> DataFrame:
    """queries with `value` of the row that resolve() finds; `missing` without one, `no_table` if ref is empty."""
    found = resolve(queries, ref, query, name, *order)
    return found.select(*queries.columns, value_of("match", value, ref, missing, no_table).alias(value))


def recent_rows(averages: DataFrame, name: str, *order: str) -> DataFrame:
    """averages as `order`, _player, _has and the ten features of RECENT, each from the first of its columns that the table has, 0 if it has none."""
    return averages.select(*order, F.col(f"`{name}`").alias("_player"), F.lit(True).alias("_has"), *(first_present(averages, names).alias(f) for f, names in RECENT.items()))


def recent_averages(queries: DataFrame, averages: DataFrame, query: str, name: str, *order: str) -> DataFrame:
    """queries with has_averages and the ten features of RECENT from the row that resolve() finds.

    A feature comes from the first of its columns that the table has, 0 if it has none; a null in that column stays
    null, and without a row all are null."""
    found = resolve(queries, recent_rows(averages, name, *order), query, "_player", *order)
    return found.select(*queries.columns, F.coalesce("match._has", F.lit(False)).alias("has_averages"), *(F.col(f"match.{f}").alias(f) for f in RECENT))


def position_of(own: Column, match: str, default: str = "SG") -> Column:
    """The position that a name has itself, else the primary one of a match's row, else the default."""
    other = F.when(F.col(match).isNotNull(), F.coalesce(F.nullif(primary_category(F.col(f"{match}.position"), POSITIONS), F.lit("")), F.lit(default)))
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), other, F.lit(default))


def own_positions(queries: DataFrame, query: str, positions: DataFrame, order: str = "o") -> DataFrame:
    """queries with _own, the position of positions(name, position) by the normalised name, where the last duplicate wins."""
    last = positions.groupBy(normalize_name(F.col("name")).alias("_n")).agg(F.max_by("position", order).alias("_own"))
    return queries.join(last.filter("_n <> ''"), normalize_name(F.col(query)) == F.col("_n"), "left").drop("_n")


def positions_of(queries: DataFrame, query: str, positions: DataFrame, info: DataFrame, order: str = "o", info_order: str = "o", default: str = "SG") -> DataFrame:
    """queries with `position`: from positions(name, position) by the normalised name, where the last duplicate wins; else the
    primary position of the first row of info(name, position) by name, then by the query's last word; else the default."""
    out = own_positions(queries, query, positions, order)
    found = resolve(out, info.select("name", "position", F.col(info_order).alias("_io")), query, "name", "_io", tiers=(1, 3))
    return found.select(*queries.columns, position_of(F.col("_own"), "match", default).alias("position"))


def season_rows(entities: DataFrame, entity: str, players: DataFrame, usage: DataFrame, as_of: str, *order: str) -> DataFrame:
    """One log row, dated as_of, for each entity whose name usage knows: `entity`, GAME_DATE and the columns of SEASON.

    The id gives the name in players(id, full_name), compared as text; the first row of usage whose PLAYER contains the name,
    whatever the case, gives the averages. Columns that usage lacks and nulls are 0. Other entities have no row."""
    who = entities.join(players, F.col(entity).cast("string") == F.col("id").cast("string")).select(entity, F.upper("full_name").alias("_needle"))
    u = usage.select(F.upper("PLAYER").alias("_name"), F.struct(*order).alias("_o"), F.struct(*(F.coalesce(first_present(usage, [c]), F.lit(0.0)).alias(c) for c in SEASON)).alias("_row"))
    u = u.groupBy("_name").agg(F.min("_o").alias("_o"), F.min_by("_row", "_o").alias("_row"))
    best = containing(who, u, "_needle", "_name").join(u, F.col("name") == F.col("_name")).groupBy("needle").agg(F.min_by("_row", "_o").alias("_row"))
    out = who.join(best, F.col("_needle") == F.col("needle"))
    return out.select(entity, F.lit(as_of).cast("date").alias("GAME_DATE"), "_row.*")


def log_or_season(entities: DataFrame, entity: str, log: DataFrame, players: DataFrame, usage: DataFrame, as_of: str, *order: str) -> DataFrame:
    """The rows of log(entity, GAME_DATE, columns of SEASON) of each entity, and season_rows() for those without any; `source` says which."""
    same = F.col(f"e.{entity}").cast("string") == F.col(f"l.{entity}").cast("string")
    own = entities.select(entity).alias("e").join(log.alias("l"), same)
    first = own.select(F.col(f"e.{entity}").alias(entity), F.col("l.GAME_DATE").cast("date").alias("GAME_DATE"), *(F.col(f"l.{c}").cast("double").alias(c) for c in SEASON), F.lit("log").alias("source"))
    rest = entities.select(entity).alias("e").join(log.alias("l"), same, "left_anti")
    return first.unionByName(season_rows(rest, entity, players, usage, as_of, *order).withColumn("source", F.lit("average")))


def lookup_chain(df: DataFrame, key: str, tables: list[tuple[DataFrame, str, str, str, bool]], default: str, out: str) -> DataFrame:
    """df with `out` from the first table that has the key: (table, its key, its value, its order, last row wins)."""
    cs = []
    for k, (t, tkey, value, order, last) in enumerate(tables):
        pick = (F.max_by if last else F.min_by)(F.col(value), F.col(order)).alias(f"_v{k}")
        df = df.join(t.groupBy(F.col(tkey).alias(f"_k{k}")).agg(pick), F.col(key) == F.col(f"_k{k}"), "left")
        cs.append(f"_v{k}")
    own = [c for c in df.columns if not c.startswith(("_k", "_v"))]
    return df.select(*own, F.coalesce(*cs, F.lit(default)).alias(out))


def fallback_join(df: DataFrame, log: DataFrame, key: str, log_key: str, alt: str, log_alt: str) -> DataFrame:
    """Rows of log for each row of df by key, as text; by the alternative key for rows without any."""
    log = log.select(*(F.col(c).alias(f"log_{c}") for c in log.columns))
    same = F.col(key).cast("string") == F.col(f"log_{log_key}").cast("string")
    first = df.join(log, same).withColumn("by", F.lit("key"))
    rest = df.join(log, same, "left_anti").join(log, F.col(alt).cast("string") == F.col(f"log_{log_alt}").cast("string")).withColumn("by", F.lit("alternative"))
    return first.unionByName(rest)


def prefer_exact(df: DataFrame, ref: DataFrame, on: str, key: str, alias: str, name: str, values: dict[str, float], *order: str, mode: str = "exact") -> DataFrame:
    """df with `values` of the row of ref (same `on`) whose name equals the alias or the key, else contains one.

    With mode "exact" equality beats containment, then `order`; with mode "first" only `order` counts. Without a match each
    value has its default. Names are compared in upper case and first found among the different names of ref; rows are
    joined by (on, name) afterwards, so nothing is paired within `on`."""
    if mode not in ("exact", "first"):
        raise ValueError(f"unknown mode: {mode}")
    names = [c for c in ref.columns if c != on]
    r = ref.select(F.col(on).alias("_on"), F.upper(F.trim(F.col(name))).alias("_name"), F.struct(*(F.col(c) for c in names)).alias("_r"))
    r = r.groupBy("_on", "_name").agg(F.min_by("_r", F.struct(*(F.col(f"_r.{o}") for o in order))).alias("_r"))
    keys = df.select(on, key, alias).distinct()
    asked = keys.select(on, key, alias, F.explode(F.array_distinct(F.array(F.upper(alias), F.upper(key)))).alias("_needle")).filter("_needle <> ''")
    pairs = containing(asked, r, "_needle", "_name", True)  # abbreviations may be short; to ask would run all that leads to df
    # The best row of each needle within each `on`, before the keys that share the needle are joined.
    rank = F.struct((F.when(F.col("name") == F.col("needle"), 0).otherwise(1) if mode == "exact" else F.lit(0)).alias("_rank"), *(F.col(f"_r.{o}") for o in order))
    first = pairs.join(r, F.col("name") == F.col("_name")).groupBy("_on", "needle").agg(F.min(rank).alias("_k"), F.min_by("_r", rank).alias("_r"))
    found = asked.join(first, (F.col(on) == F.col("_on")) & (F.col("_needle") == F.col("needle")))
    best = found.groupBy(F.col(on).alias("_a"), F.col(key).alias("_b"), F.col(alias).alias("_c")).agg(F.min_by("_r", "_k").alias("_best"))
    same = F.col(on).eqNullSafe(F.col("_a")) & F.col(key).eqNullSafe(F.col("_b")) & F.col(alias).eqNullSafe(F.col("_c"))
    return df.join(best, same, "left").select(*df.columns, *(F.coalesce(F.col(f"_best.{v}").cast("double"), F.lit(d)).alias(v) for v, d in values.items()))
