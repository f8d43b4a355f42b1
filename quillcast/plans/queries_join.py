"""Queries for lookups, name resolution, schedules and key joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.functions import text as ft
from quillcast.operators import resolve, schedule
from quillcast.plans.catalog import Tables, query

#: Names are looked up for every customer: the segment and number make texts of all three tiers.
LOOKUP_SQL = """q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN (ARRAY['small ring','Red Widget','blue bolt','hot gear'])[1 + c_custkey % 3] WHEN 1 THEN (ARRAY['MALL RI','ed wid','ue bo'])[1 + c_custkey % 3]
  WHEN 2 THEN (ARRAY['unknown bolt','Zed GEAR','no ring'])[1 + c_custkey % 3] ELSE (ARRAY['nothing at all','','zz'])[1 + c_custkey % 3] END AS name FROM customer),
n AS (SELECT *, upper(trim(name)) AS qn, string_split(upper(trim(name)), ' ')[-1] AS last FROM q),
m AS (SELECT c_custkey, p_partkey, p_size, CASE WHEN upper(p_name) = qn THEN 1 WHEN contains(upper(p_name), qn) THEN 2 ELSE 3 END AS tier FROM n JOIN part ON qn <> '' AND (contains(upper(p_name), qn) OR contains(upper(p_name), last))),
b AS (SELECT c_custkey, tier, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, p_partkey) AS k FROM m) WHERE k = 1)"""


def lookups(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda *names: F.get(F.array(*(F.lit(n) for n in names)), (k % 3).cast("int"))
    name = F.when(k % 4 == 0, pick("small ring", "Red Widget", "blue bolt")).when(k % 4 == 1, pick("MALL RI", "ed wid", "ue bo"))
    return t.customer.select(k, name.when(k % 4 == 2, pick("unknown bolt", "Zed GEAR", "no ring")).otherwise(pick("nothing at all", "", "zz")).alias("name"))


@query("resolve_names", f"WITH {LOOKUP_SQL} SELECT n.c_custkey, n.name, CAST(tier AS INT) AS tier, p_partkey FROM n LEFT JOIN b USING (c_custkey)")
def resolve_names(t: Tables) -> DataFrame:
    found = resolve.resolve(lookups(t), t.part.select("p_partkey", "p_name"), "name", "p_name", "p_partkey")
    return found.select("c_custkey", "name", "tier", F.col("match.p_partkey").alias("p_partkey"))


@query("resolve_with_default", f"WITH {LOOKUP_SQL} SELECT n.c_custkey, coalesce(CAST(p_size AS DOUBLE), 20.0) AS p_size FROM n LEFT JOIN b USING (c_custkey)")
def resolve_with_default(t: Tables) -> DataFrame:
    return resolve.resolve_value(lookups(t), t.part.select("p_partkey", "p_name", "p_size"), "name", "p_name", "p_size", "p_partkey").select("c_custkey", "p_size")


@query("resolve_features", f"WITH {LOOKUP_SQL} SELECT n.c_custkey, CAST(p_size AS DOUBLE) AS pts, CASE WHEN p_size IS NOT NULL THEN 0.0 END AS fg3a FROM n LEFT JOIN b USING (c_custkey)")
def resolve_features(t: Tables) -> DataFrame:
    found = resolve.resolve(lookups(t), t.part.select("p_partkey", "p_name", "p_size"), "name", "p_name", "p_partkey")
    row = F.col("match")
    return found.select("c_custkey", row["p_size"].cast("double").alias("pts"), F.when(row.isNotNull(), F.lit(0.0)).alias("fg3a"))


@query("lookup_chain", """SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 3 = 0 THEN n_name END, CASE WHEN c_nationkey % 3 = 1 THEN r_name END, 'SG') AS position FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def lookup_chain(t: Tables) -> DataFrame:
    first = t.nation.filter(F.col("n_nationkey") % 3 == 0)
    second = t.nation.filter(F.col("n_nationkey") % 3 == 1).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    chain = [(first, "n_nationkey", "n_name", "n_nationkey", True), (second, "n_nationkey", "r_name", "n_nationkey", False)]
    return resolve.lookup_chain(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", chain, "SG", "position").select("c_custkey", "position")


@query("id_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR)")
def id_join(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey").cast("string") == F.col("c_custkey").cast("string")).select("o_orderkey", "c_name")


@query("fallback_key_join", """WITH c AS (SELECT c_custkey, c_custkey * 2 AS id, c_custkey % 100 AS alt FROM customer), x AS (SELECT c_custkey, o_orderkey, 'key' AS by FROM c JOIN orders ON o_custkey = id)
  SELECT * FROM x UNION ALL SELECT c_custkey, o_orderkey, 'alternative' FROM c JOIN orders ON o_custkey = alt WHERE c_custkey NOT IN (SELECT c_custkey FROM x)""")
def fallback_key_join(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", (F.col("c_custkey") * 2).alias("id"), (F.col("c_custkey") % 100).alias("alt"))
    out = resolve.fallback_join(c, t.orders.select("o_orderkey", "o_custkey"), "id", "o_custkey", "alt", "o_custkey")
    return out.select("c_custkey", F.col("log_o_orderkey").alias("o_orderkey"), "by")


@query("season_average_fallback", """SELECT c_custkey, CAST(o_totalprice AS DOUBLE) AS pts, 'log' AS source FROM customer JOIN orders ON o_custkey = c_custkey * 2
  UNION ALL SELECT c_custkey, coalesce(c_acctbal, 0), 'average' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey * 2)""")
def season_average_fallback(t: Tables) -> DataFrame:
    c, same = t.customer, F.col("o_custkey") == F.col("c_custkey") * 2
    log = c.join(t.orders, same).select("c_custkey", F.col("o_totalprice").alias("pts"), F.lit("log").alias("source"))
    rest = c.join(t.orders, same, "left_anti").select("c_custkey", F.coalesce("c_acctbal", F.lit(0.0)).alias("pts"), F.lit("average").alias("source"))
    return log.unionByName(rest, allowMissingColumns=True)


@query("team_id_lookup", "SELECT s_suppkey, nullif(n_nationkey, 0) AS team_id FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def team_id_lookup(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.nullif("n_nationkey", F.lit(0)).alias("team_id"))


def games(t: Tables) -> DataFrame:
    """A game for each line item: the customer's nation at home, the supplier's visiting."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sides = lines.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return sides.select(F.col("l_orderkey").alias("game_id"), F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("visitor"))


GAMES_SQL = "g AS (SELECT l_orderkey AS game_id, c_nationkey AS home, s_nationkey AS visitor FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


@query("schedule_expand", f"WITH {GAMES_SQL} SELECT game_id, home AS team, visitor AS opponent, CAST(1 AS INT) AS is_home FROM g UNION ALL SELECT game_id, visitor, home, 0 FROM g WHERE home <> visitor")
def schedule_expand(t: Tables) -> DataFrame:
    return schedule.expand(games(t), "home", "visitor").select("game_id", "team", "opponent", "is_home")


@query("or_join_rewrite", f"WITH {GAMES_SQL} SELECT n_name, count(*) AS n_games, CAST(sum(CASE WHEN home = n_nationkey THEN 1 ELSE 0 END) AS BIGINT) AS n_home FROM nation JOIN g ON home = n_nationkey OR visitor = n_nationkey GROUP BY n_name")
def or_join_rewrite(t: Tables) -> DataFrame:
    # Counted by team before the join, so one row for each team is joined.
    per = schedule.expand(games(t), "home", "visitor").groupBy("team").agg(F.count("*").alias("n_games"), F.sum("is_home").alias("n_home"))
    return t.nation.join(per, F.col("n_nationkey") == F.col("team")).select("n_name", "n_games", "n_home")


@query("name_to_id", "SELECT n_name, CAST(coalesce(CASE WHEN r_name <> 'ASIA' THEN r_regionkey END, 0) AS BIGINT) AS region_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def name_to_id(t: Tables) -> DataFrame:
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    return schedule.name_to_id(named, "r_name", t.region.filter("r_name <> 'ASIA'"), "r_name", "r_regionkey", "region_id").select("n_name", "region_id")


@query("game_context", f"""WITH {GAMES_SQL}, s AS (SELECT game_id, home AS team, visitor AS opponent, 1 AS is_home FROM g UNION ALL SELECT game_id, visitor, home, 0 FROM g WHERE home <> visitor),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY game_id, opponent, is_home) AS k FROM s) WHERE k = 1)
  SELECT c_custkey, f.opponent AS opponent_id, CASE WHEN f.opponent IS NOT NULL THEN coalesce(CASE WHEN f.opponent % 5 <> 0 THEN n_name END, 'UNK') END AS opponent, CAST(is_home AS INT) AS is_home
  FROM customer LEFT JOIN f ON team = c_nationkey LEFT JOIN nation ON n_nationkey = f.opponent""")
def game_context(t: Tables) -> DataFrame:
    known = t.nation.filter(F.col("n_nationkey") % 5 != 0)
    out = schedule.game_context(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", games(t), "home", "visitor", known, "n_nationkey", "n_name", "game_id", "opponent")
    return out.select("c_custkey", "opponent_id", "opponent", "is_home")


REGIONS = {"AFRICA": "AFR", "ASIA": "ASI", "EUROPE": "EUR"}


@query("alias_map", "SELECT r_regionkey, CASE r_name WHEN 'AFRICA' THEN 'AFR' WHEN 'ASIA' THEN 'ASI' WHEN 'EUROPE' THEN 'EUR' ELSE r_name END AS alias FROM region")
def alias_map(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", ft.alias(F.col("r_name"), REGIONS).alias("alias"))


@query("abbr_expand", "SELECT n_nationkey, coalesce(r_name, upper('r' || n_nationkey)) AS full_name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def abbr_expand(t: Tables) -> DataFrame:
    names = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("abbreviation"), F.col("r_name").alias("_full"))
    key = F.upper(F.concat(F.lit("r"), "n_nationkey"))
    return t.nation.withColumn("_key", key).join(names, F.col("_key") == F.col("abbreviation"), "left").select("n_nationkey", F.coalesce("_full", "_key").alias("full_name"))


@query("position_defense_join", """WITH d AS (SELECT p_type AS position, 'NATION_' || s_nationkey AS team, round(avg(l_quantity), 6) AS pts FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
  q AS (SELECT n_nationkey, p_type AS position, n_name AS key, CASE WHEN n_nationkey < 5 THEN n_name ELSE 'N' || n_nationkey END AS alias FROM nation, (SELECT DISTINCT p_type FROM part) WHERE n_nationkey % 2 = 0),
  m AS (SELECT q.*, d.pts, CASE WHEN team IN (key, alias) THEN 0 ELSE 1 END AS rank, team FROM q JOIN d ON d.position = q.position AND (contains(team, key) OR contains(team, alias)))
  SELECT q.n_nationkey, q.position, coalesce((SELECT pts FROM m WHERE m.n_nationkey = q.n_nationkey AND m.position = q.position ORDER BY rank, team LIMIT 1), 45.0) AS pts FROM q""")
def position_defense_join(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity").join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    defense = lines.groupBy(F.col("p_type").alias("position"), F.concat(F.lit("NATION_"), "s_nationkey").alias("team")).agg(F.round(F.avg("l_quantity"), 6).alias("pts"))
    # Every even nation for every position: the positions are one row with an array, which each nation gets and takes apart.
    every = t.part.agg(F.array_sort(F.collect_set("p_type")).alias("every")).withColumn("_one", F.lit(1))
    asked = t.nation.filter(F.col("n_nationkey") % 2 == 0).withColumn("_one", F.lit(1)).join(every, "_one").withColumn("position", F.explode("every"))
    asked = asked.select("n_nationkey", "position", F.col("n_name").alias("key"), F.when(F.col("n_nationkey") < 5, F.col("n_name")).otherwise(F.concat(F.lit("N"), "n_nationkey")).alias("alias"))
    return resolve.prefer_exact(asked, defense, "position", "key", "alias", "team", {"pts": 45.0}, "team").select("n_nationkey", "position", "pts")


@query("roster_enrich", "SELECT s_suppkey, n_name AS team_name, r_name AS conference FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def roster_enrich(t: Tables) -> DataFrame:
    teams = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(teams, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("team_name"), F.col("r_name").alias("conference"))


@query("entities_with_log", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def entities_with_log(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("entities_without_log", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def entities_without_log(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")
