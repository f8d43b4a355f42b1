"""Queries of the prediction from names, of its lookups, and of the ingest plans over page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.operators import models, resolve
from quillcast.operators.augment import FEATURES
from quillcast.plans import forecast, ingest
from quillcast.plans.catalog import Tables, query
from quillcast.plans.queries_forecast import PLAIN_SQL, features
from quillcast.plans.queries_join import LOOKUP_SQL, lookups
from quillcast.sources import odds, snapshots, tables

#: Odds documents whose keys change with the event: each field is found under one of its keys.
ODDS_DOCUMENT = """concat('{"', wrapper, '":[{"', element_at(array('home_team', 'home', 'homeTeam'), 1 + k3), '":"', event_type, '","', element_at(array('away_team', 'away', 'awayTeam'), 1 + k3), '":"u', user_id, '","',
 element_at(array('date', 'start_time', 'datetime'), 1 + k3), '":"d', k3, '","', element_at(array('markets', 'odds'), 1 + k2), '":{"', element_at(array('spreads', 'spread'), 1 + k2), '":', spread, ',"', element_at(array('totals', 'total'), 1 + k2), '":[', total, ']}}]}')"""
ODDS_SPREAD = """concat('{"', element_at(array('home_handicap', 'home_line', 'handicap'), 1 + k3), '":', v, ',"', element_at(array('home_odds', 'odds_home'), 1 + k2), '":-110,"', element_at(array('away_handicap', 'away_line'), 1 + k2), '":', v + 1, ',"', element_at(array('away_odds', 'odds_away'), 1 + k2), '":-105}')"""
ODDS_TOTAL = """concat('{"', element_at(array('total', 'line', 'total_line'), 1 + k3), '":', 200 + v, ',"', element_at(array('over_odds', 'over'), 1 + k2), '":0,"', element_at(array('under_odds', 'under'), 1 + k2), '":-120}')"""


@query("odds_all_keys", """WITH e AS (SELECT event_type, user_id, event_id % 3 AS k3, event_id % 2 AS k2, CAST(json_extract_string(props, '$.k') AS BIGINT) - 50 AS v FROM events)
  SELECT event_type AS home_team, 'u' || user_id AS away_team, 'd' || k3 AS date, 'basketball' AS sport, CASE WHEN v = 0 AND k3 < 2 THEN NULL ELSE v::DOUBLE END AS home_spread, -110.0::DOUBLE AS home_spread_odds,
  CASE WHEN v + 1 = 0 AND k2 = 0 THEN NULL ELSE (v + 1)::DOUBLE END AS away_spread, -105.0::DOUBLE AS away_spread_odds, (200 + v)::DOUBLE AS total_line, CASE WHEN k2 = 1 THEN 0.0::DOUBLE END AS over_odds, -120.0::DOUBLE AS under_odds FROM e""")
def odds_all_keys(t: Tables) -> DataFrame:
    e = t.events.select("event_type", "user_id", F.expr("cast(event_id % 3 as int)").alias("k3"), F.expr("cast(event_id % 2 as int)").alias("k2"), F.expr("cast(get_json_object(props, '$.k') as bigint) - 50").alias("v"), F.expr("element_at(array('data', 'matches', 'events'), 1 + cast(event_id % 3 as int))").alias("wrapper"))
    e = e.withColumn("spread", F.when(F.col("k3") == 1, F.concat(F.lit("["), F.expr(ODDS_SPREAD), F.lit("]"))).otherwise(F.expr(ODDS_SPREAD))).withColumn("total", F.expr(ODDS_TOTAL))
    return odds.flatten(odds.matches(e.select(F.expr(ODDS_DOCUMENT).alias("value"))))


@query("recent_averages", f"""WITH {LOOKUP_SQL}, a AS (SELECT p_partkey, p_size::DOUBLE AS pts, p_retailprice AS reb, p_partkey % 7 AS m3 FROM part)
  SELECT n.c_custkey, b.p_partkey IS NOT NULL AS has_averages, a.pts AS pts_roll_avg, round(a.reb, 4) AS reb_roll_avg, CASE WHEN b.p_partkey IS NOT NULL THEN 0.0::DOUBLE END AS ast_roll_avg, CASE WHEN b.p_partkey IS NOT NULL THEN 0.0::DOUBLE END AS min_roll_avg,
  (a.m3 * 2)::DOUBLE AS fga_roll_avg, a.m3::DOUBLE AS fg3a_roll_avg, (a.m3 + 1)::DOUBLE AS fta_roll_avg, CASE WHEN b.p_partkey IS NOT NULL THEN 0.0::DOUBLE END AS stl_roll_avg, CASE WHEN b.p_partkey IS NOT NULL THEN 0.0::DOUBLE END AS blk_roll_avg, CASE WHEN a.m3 = 3 THEN NULL ELSE a.m3::DOUBLE END AS tov_roll_avg
  FROM n LEFT JOIN b USING (c_custkey) LEFT JOIN a ON a.p_partkey = b.p_partkey""")
def recent_averages(t: Tables) -> DataFrame:
    m3 = F.col("p_partkey") % 7
    table = t.part.select("p_partkey", F.col("p_name").alias("Player"), F.col("p_size").alias("PTS"), F.col("p_retailprice").alias("REB"), (m3 * 2).alias("2PM"), m3.alias("3PM"), (m3 + 1).alias("FTM"), F.when(m3 != 3, m3).alias("TO"))
    out = resolve.recent_averages(lookups(t), table, "name", "Player", "p_partkey").drop("name")
    return out.withColumn("reb_roll_avg", F.round("reb_roll_avg", 4))


@query("position_chain", """WITH q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'small ring' WHEN 1 THEN 'Blue BOLT' WHEN 2 THEN 'unknown bolt' ELSE 'nobody' END AS name FROM customer),
  p AS (SELECT upper(trim(p_name)) AS n, arg_max(p_type, p_partkey) AS position FROM part WHERE p_partkey % 3 = 0 AND p_name LIKE '%ring' GROUP BY 1),
  i AS (SELECT p_partkey, upper(trim(p_name)) AS n, CASE p_size % 3 WHEN 0 THEN 'G-F' WHEN 1 THEN ' F' ELSE 'C-X' END AS position FROM part WHERE p_partkey % 3 <> 0),
  m AS (SELECT c_custkey, i.position, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN n = upper(name) THEN 1 ELSE 3 END, p_partkey) AS k FROM q JOIN i ON n = upper(name) OR contains(n, string_split(upper(name), ' ')[-1]))
  SELECT q.c_custkey, coalesce(p.position, CASE trim(string_split(m.position, '-')[1]) WHEN 'G' THEN 'SG' WHEN 'F' THEN 'SF' ELSE trim(string_split(m.position, '-')[1]) END, 'SG') AS position
  FROM q LEFT JOIN p ON p.n = upper(name) LEFT JOIN m ON m.c_custkey = q.c_custkey AND k = 1""")
def position_chain(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    asked = t.customer.select("c_custkey", F.when(k == 0, "small ring").when(k == 1, "Blue BOLT").when(k == 2, "unknown bolt").otherwise("nobody").alias("name"))
    positions = t.part.filter((F.col("p_partkey") % 3 == 0) & F.col("p_name").like("%ring")).select(F.col("p_name").alias("name"), F.col("p_type").alias("position"), F.col("p_partkey").alias("o"))
    label = F.when(F.col("p_size") % 3 == 0, "G-F").when(F.col("p_size") % 3 == 1, " F").otherwise("C-X")
    info = t.part.filter(F.col("p_partkey") % 3 != 0).select(F.col("p_name").alias("name"), label.alias("position"), F.col("p_partkey").alias("o"))
    return resolve.positions_of(asked, "name", positions, info).select("c_custkey", "position")


@query("log_or_season", """WITH e AS (SELECT c_custkey FROM customer), u AS (SELECT s_suppkey, upper('Mr ' || s_name) AS n, s_acctbal FROM supplier),
  w AS (SELECT c_custkey, 'supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') AS full_name FROM customer WHERE c_custkey % 5 <> 0),
  r AS (SELECT c_custkey FROM e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')),
  m AS (SELECT r.c_custkey, s_acctbal, row_number() OVER (PARTITION BY r.c_custkey ORDER BY s_suppkey) AS k FROM r JOIN w USING (c_custkey) JOIN u ON contains(n, upper(full_name)))
  SELECT c_custkey, DATE '1998-10-03' AS GAME_DATE, round(s_acctbal, 2) AS PTS, 0.0::DOUBLE AS TOV, 'average' AS source FROM m WHERE k = 1
  UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), round(o_totalprice, 2), 1.0::DOUBLE, 'log' FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM e)""")
def log_or_season(t: Tables) -> DataFrame:
    log = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("GAME_DATE"), F.col("o_totalprice").alias("PTS"), *(F.lit(1.0).alias(c) for c in resolve.SEASON[1:]))
    players = t.customer.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("supplier#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0")).alias("full_name"))
    usage = t.supplier.select(F.concat(F.lit("Mr "), "s_name").alias("PLAYER"), F.col("s_acctbal").alias("PTS"), "s_suppkey")
    out = resolve.log_or_season(t.customer, "c_custkey", log, players, usage, "1998-10-03", "s_suppkey")
    return out.select("c_custkey", "GAME_DATE", F.round("PTS", 2).alias("PTS"), "TOV", "source")


@query("position_defense_first", """WITH d AS (SELECT s_suppkey AS o, 'P' || s_suppkey % 3 AS position, upper(s_name) AS team, s_acctbal AS pts FROM supplier),
  q AS (SELECT n_nationkey, 'P' || n_nationkey % 3 AS position, '#00000000' || n_nationkey % 10 AS key, CASE WHEN n_nationkey % 4 = 0 THEN '00000001' ELSE 'none' END AS alias FROM nation),
  m AS (SELECT n_nationkey, pts, row_number() OVER (PARTITION BY n_nationkey ORDER BY o) AS k FROM q JOIN d ON d.position = q.position AND (contains(team, upper(key)) OR contains(team, upper(alias))))
  SELECT q.n_nationkey, coalesce(m.pts, 45.0) AS pts FROM q LEFT JOIN m ON m.n_nationkey = q.n_nationkey AND k = 1""")
def position_defense_first(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    asked = t.nation.select(n, F.concat(F.lit("P"), (n % 3).cast("string")).alias("position"), F.concat(F.lit("#00000000"), (n % 10).cast("string")).alias("key"), F.when(n % 4 == 0, "00000001").otherwise("none").alias("alias"))
    ref = t.supplier.select(F.concat(F.lit("P"), (F.col("s_suppkey") % 3).cast("string")).alias("position"), F.col("s_name").alias("team"), F.col("s_acctbal").alias("pts"), F.col("s_suppkey").alias("o"))
    return resolve.prefer_exact(asked, ref, "position", "key", "alias", "team", {"pts": 45.0}, "o", mode="first").select("n_nationkey", "pts")


def schedule_pages(t: Tables, whole: bool = False) -> DataFrame:
    """A schedule page for each customer, with a row for each order; unless `whole` some rows lack the date or cells."""
    k = F.col("o_orderkey")
    cells = [
        F.concat(F.lit('<th data-stat="date_game">'), F.when((k % 10 != 0) | F.lit(whole), F.date_format("o_orderdate", "EEE, MMM d, yyyy")).otherwise(""), F.lit("</th>")), F.lit("<td>8:00p</td><td>"),
        F.concat(F.lit("V"), k % 30, F.lit("</td><td>"), k % 100, F.lit("</td><td>H"), k % 29, F.lit("</td><td>")), F.concat(k % 90, F.lit("</td>")),
        F.when(k % 7 == 0, F.lit('<td data-stat="box_score_text">x</td>')).otherwise(F.concat(F.lit('<td data-stat="box_score_text"><a href="/boxscores/g'), k.cast("string"), F.lit('.html">Box Score</a></td>'))),
    ]
    row = F.when((k % 11 == 0) & ~F.lit(whole), F.lit("<tr><td>too</td><td>few</td></tr>")).otherwise(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")))
    # A customer's orders are few.
    rows = t.orders.select("o_custkey", row.alias("row")).groupBy("o_custkey").agg(F.array_join(F.collect_list("row"), "").alias("rows"))
    return rows.select(F.col("o_custkey").alias("page_id"), F.concat(F.lit('<p>Games</p><table id="schedule"><thead><tr class="thead"><th>Date</th></tr></thead><tbody>'), "rows", F.lit("</tbody></table><table id=\"schedule\"><tr>" + "<td>again</td>" * 7 + "</tr></table>")).alias("html"))


@query("ingest_schedule_games", """SELECT o_custkey AS page_id, strftime(o_orderdate, '%a, %b ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') AS date, 'V' || o_orderkey % 30 AS visitor_team, CAST(o_orderkey % 100 AS VARCHAR) AS visitor_pts,
  'H' || o_orderkey % 29 AS home_team, CAST(o_orderkey % 90 AS VARCHAR) AS home_pts, CASE WHEN o_orderkey % 7 <> 0 THEN 'g' || o_orderkey END AS game_id FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 <> 0""")
def ingest_schedule_games(t: Tables) -> DataFrame:
    games, _ = ingest.split_errors(ingest.schedule_games(schedule_pages(t)))
    return games.drop("row_ix")


@query("daily_refresh", "SELECT 'slate' AS step, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03') AS n_rows UNION ALL SELECT 'players', count(*) FROM customer UNION ALL SELECT 'schedule', count(*) FROM orders")
def daily_refresh(t: Tables) -> DataFrame:
    """The whole refresh from pages of all orders, and the rows of what it stored."""
    base = tables.scratch(t.spark)
    teams = t.nation.select(F.col("n_nationkey").alias("id"), F.explode(F.array(F.concat(F.lit("H"), "n_nationkey"), F.concat(F.lit("V"), "n_nationkey"))).alias("full_name"))
    players = ingest.refresh(t.customer, schedule_pages(t, True), teams, "1998-10-03", base, 1998, "pages")
    count = lambda step, df: df.agg(F.count("*").alias("n_rows")).select(F.lit(step).alias("step"), "n_rows")
    today = t.spark.read.schema("game_id string").json(f"{base}/todays_games.json")
    stored = snapshots.read(t.spark, f"{base}/schedule")
    games = count("schedule", stored if stored is not None else today.limit(0))
    return count("slate", today).unionByName(players.select(F.lit("players").alias("step"), "n_rows")).unionByName(games)


@query("ingest_todays_games", """SELECT o_orderkey AS game, CASE WHEN o_orderkey % 29 < 25 THEN o_orderkey % 29 END AS HOME_TEAM_ID, CASE WHEN o_orderkey % 30 < 25 THEN o_orderkey % 30 END AS VISITOR_TEAM_ID
  FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND month(o_orderdate) = 3 AND day(o_orderdate) = 9 AND year(o_orderdate) = 1995""")
def ingest_todays_games(t: Tables) -> DataFrame:
    games, _ = ingest.split_errors(ingest.schedule_games(schedule_pages(t)))
    teams = t.nation.select(F.col("n_nationkey").alias("id"), F.explode(F.array(F.concat(F.lit("H"), "n_nationkey"), F.concat(F.lit("V"), "n_nationkey"))).alias("full_name"))
    today = ingest.todays_games(games.filter("game_id IS NOT NULL"), teams, "1995-03-09")
    return today.select(F.substring("game_id", 2, 20).cast("long").alias("game"), "HOME_TEAM_ID", "VISITOR_TEAM_ID")


def roster_pages(t: Tables) -> DataFrame:
    """Roster pages of a nation's suppliers, about twenty on each; every fifth row has no link."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("First"), k % 9, F.lit(" "), "s_name")
    link = F.when(k % 5 == 0, F.col("s_name")).otherwise(F.concat(F.lit('<a href="/players/s/s'), k.cast("string"), F.lit('.html">'), F.when(k % 3 == 0, F.col("s_name")).otherwise(name), F.lit("</a> (TW)")))
    row = F.concat(F.lit("<tr><th>"), k % 50, F.lit("</th><td>"), link, F.lit("</td><td>PG</td><td>6-1</td><td>200</td><td>May 3</td><td>us</td><td>R</td><td>C"), k % 4, F.lit("</td></tr>"))
    pages = t.supplier.groupBy("s_nationkey", F.floor(k / 500).alias("part")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    return pages.select((F.col("s_nationkey") * 1_000_000 + F.col("part")).alias("page_id"), F.concat(F.lit("T"), "s_nationkey").alias("team_abbreviation"), F.concat(F.lit('<table id="roster"><tbody>'), "rows", F.lit("</tbody></table>")).alias("html"))


ROSTER_SQL = "r AS (SELECT 's' || s_suppkey AS player_id, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'First' || s_suppkey % 9 || ' ' || s_name END AS player_name, * FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0)"


@query("ingest_roster_info", f"WITH {ROSTER_SQL} SELECT player_id, player_name, n_nationkey AS team_id, 'T' || n_nationkey AS team_abbreviation, n_name AS team_name, 'PG' AS position, CAST(s_suppkey % 50 AS VARCHAR) AS jersey, 'C' || s_suppkey % 4 AS college FROM r")
def ingest_roster_info(t: Tables) -> DataFrame:
    info, _ = ingest.roster_players(roster_pages(t), roster_teams(t))
    return info.select("player_id", "player_name", "team_id", "team_abbreviation", "team_name", "position", "jersey", "college")


@query("ingest_roster_players", f"WITH {ROSTER_SQL} SELECT player_id AS id, player_name AS full_name, CASE WHEN contains(player_name, ' ') THEN string_split(player_name, ' ')[1] ELSE '' END AS first_name, string_split(player_name, ' ')[-1] AS last_name FROM r")
def ingest_roster_players(t: Tables) -> DataFrame:
    return ingest.roster_players(roster_pages(t), roster_teams(t))[1]


def roster_teams(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("full_name"), F.concat(F.lit("T"), "n_nationkey").alias("abbreviation"))


def sources(t: Tables) -> forecast.Sources:
    """The tables of a prediction: customers as players, nations as teams, their orders as recent games."""
    info = t.customer.select(F.col("c_custkey").cast("string").alias("player_id"), F.col("c_name").alias("player_name"), F.col("c_nationkey").alias("team_id"), F.col("c_mktsegment").alias("position"), F.col("c_custkey").alias("o"))
    per = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("PTS"), F.count("*").alias("REB"), (F.max("o_orderkey") % 9).alias("AST"))
    averages = per.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("Player"), "PTS", "REB", "AST", (F.col("REB") * 2).alias("2PM"), F.col("REB").alias("3PM"), F.col("c_custkey").alias("o"))
    usage = t.customer.filter("c_custkey % 5 <> 0").select(F.col("c_name").alias("PLAYER"), F.pmod(F.floor(F.col("c_acctbal") / 400), F.lit(30)).cast("double").alias("USGPCT"), F.col("c_custkey").alias("o"))
    games = t.nation.filter("n_nationkey % 5 <> 4").select(F.col("n_nationkey").alias("home"), ((F.col("n_nationkey") * 7 + 1) % 25).alias("visitor"), F.col("n_nationkey").alias("o"))
    teams = t.nation.filter("n_nationkey <> 8").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("abbreviation"))
    positions = t.customer.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("position"), F.col("c_custkey").alias("o"))
    defense = t.customer.groupBy(F.col("c_mktsegment").alias("position"), F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").cast("string").alias("PTS"), F.count("*").cast("string").alias("REB"), F.lit(7).alias("AST"))
    defense = defense.join(t.nation, F.col("k") == F.col("n_nationkey")).select("position", F.concat(F.lit("x"), "n_name").alias("Team"), F.concat_ws(" ", "PTS", F.lit("3")).alias("PTS"), "REB", "AST", F.col("k").alias("o"))
    return forecast.Sources(info, averages, usage, games, teams, positions, defense)


def asked(t: Tables) -> DataFrame:
    """A request for each customer: by name in other letters, by a part of one, or by one that nobody has."""
    k = F.col("c_custkey")
    name = F.when(k % 9 == 0, F.concat(F.lit("nobody "), k.cast("string"), F.lit("x"))).when(k % 9 == 1, F.substring("c_name", 7, 30)).otherwise(F.concat(F.lit(" "), F.lower("c_name")))
    stat = F.get(F.array(F.lit("Points"), F.lit("rebounds"), F.lit("ASSISTS"), F.lit("fantasy")), (k % 4).cast("int"))
    return t.customer.select(k.alias("request_id"), name.alias("name"), stat.alias("stat"), (k % 21 - 10).cast("double").alias("spread"), (200 + k % 50).cast("double").alias("total"))


REQUEST_SQL = f"""q AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 9 = 0 THEN 'nobody ' || c_custkey || 'x' WHEN c_custkey % 9 = 1 THEN substr(c_name, 7, 30) ELSE ' ' || lower(c_name) END AS name, CAST(c_custkey % 21 - 10 AS DOUBLE) AS spread, CAST(200 + c_custkey % 50 AS DOUBLE) AS total FROM customer),
  u AS (SELECT request_id, upper(trim(name)) AS qn FROM q),
  pick AS (SELECT request_id, c.c_custkey, c_nationkey, c_mktsegment FROM (SELECT u.request_id, c_custkey, row_number() OVER (PARTITION BY u.request_id ORDER BY CASE WHEN upper(c_name) = qn THEN 1 ELSE 2 END, c_custkey) AS k FROM u JOIN customer ON contains(upper(c_name), qn)) p JOIN customer c ON c.c_custkey = p.c_custkey WHERE k = 1),
  avgs AS (SELECT o_custkey, c_name, max(o_totalprice) AS pts, count(*)::DOUBLE AS reb, (max(o_orderkey) % 9)::DOUBLE AS ast FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  av AS (SELECT * FROM (SELECT request_id, a.*, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN upper(c_name) = qn THEN 1 ELSE 2 END, o_custkey) AS k FROM u JOIN avgs a ON contains(upper(c_name), qn)) WHERE k = 1),
  us AS (SELECT * FROM (SELECT request_id, CAST(((floor(c_acctbal / 400) % 30) + 30) % 30 AS DOUBLE) AS usage, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN upper(c_name) = qn THEN 1 ELSE 2 END, c_custkey) AS k FROM u JOIN customer ON c_custkey % 5 <> 0 AND contains(upper(c_name), qn)) WHERE k = 1),
  g AS (SELECT n_nationkey AS home, (n_nationkey * 7 + 1) % 25 AS visitor FROM nation WHERE n_nationkey % 5 <> 4),
  s AS (SELECT home AS team, visitor AS opponent, 1 AS is_home, home AS o FROM g UNION ALL SELECT visitor, home, 0, home FROM g WHERE home <> visitor),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY o, is_home) AS k FROM s) WHERE k = 1),
  po AS (SELECT u.request_id, coalesce((SELECT lower(c_mktsegment) FROM customer WHERE c_custkey % 3 = 0 AND upper(c_name) = qn), p.c_mktsegment, 'SG') AS position FROM u LEFT JOIN pick p ON p.request_id = u.request_id),
  d AS (SELECT c_mktsegment AS position, upper('x' || n_name) AS team, max(c_acctbal) AS pts, count(*)::DOUBLE AS reb, n_nationkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name, n_nationkey),
  x AS (SELECT q.*, p.c_custkey, p.c_nationkey, po.position, f.opponent AS opponent_id, CASE WHEN f.opponent IS NOT NULL THEN coalesce(CASE WHEN f.opponent <> 8 THEN n_name END, 'UNK') END AS opponent, f.is_home,
    CASE WHEN p.c_custkey IS NULL THEN 'not_found' WHEN av.request_id IS NULL THEN 'no_averages' WHEN f.opponent IS NULL THEN 'no_game' ELSE 'ok' END AS status, av.pts, av.reb, av.ast, us.usage
    FROM q LEFT JOIN pick p USING (request_id) LEFT JOIN av USING (request_id) LEFT JOIN us USING (request_id) LEFT JOIN po USING (request_id) LEFT JOIN f ON f.team = nullif(p.c_nationkey, 0) LEFT JOIN nation ON n_nationkey = f.opponent),
  de AS (SELECT * FROM (SELECT request_id, d.pts, d.reb, row_number() OVER (PARTITION BY request_id ORDER BY d.o) AS k FROM x JOIN d ON d.position = x.position AND contains(d.team, x.opponent)) WHERE k = 1)"""


@query("request_states", f"WITH {REQUEST_SQL} SELECT request_id, CAST(c_custkey AS VARCHAR) AS player_id, position, opponent, status FROM x")
def request_states(t: Tables) -> DataFrame:
    return forecast.request_features(asked(t), sources(t)).select("request_id", "player_id", "position", "opponent", "status")


@query("request_features", f"""WITH {REQUEST_SQL} SELECT x.request_id, status, coalesce(x.pts, 0) AS pts, coalesce(x.reb, 0) AS reb, coalesce(x.ast, 0) AS ast, 0.0::DOUBLE AS mins, coalesce(x.reb * 2, 0) AS fga, coalesce(x.reb, 0) AS fg3a, 0.0::DOUBLE AS fta, 0.0::DOUBLE AS stl, 0.0::DOUBLE AS blk, 0.0::DOUBLE AS tov,
  coalesce(usage, 20.0) AS usage_rate, is_home::DOUBLE AS is_home, spread, total, coalesce(de.pts, 25.0) AS opp_pts_allowed, coalesce(de.reb, 8.0) AS opp_reb_allowed, CASE WHEN de.request_id IS NOT NULL THEN 7.0 ELSE 6.0 END::DOUBLE AS opp_ast_allowed, coalesce(de.pts, 45.0) AS opp_fd_allowed FROM x LEFT JOIN de USING (request_id)""")
def request_features(t: Tables) -> DataFrame:
    return forecast.request_features(asked(t), sources(t)).select("request_id", "status", *FEATURES)


@query("predict_requests")
def predict_requests(t: Tables) -> DataFrame:
    """From names to answers; all six models, 100 noisy rows for each request."""
    out = forecast.predict_requests(asked(t), sources(t))
    return out.select("request_id", "player", "status", "target_stat", "prediction", "confidence", "usage_rate", "game_context.*", F.to_json("individual_predictions").alias("individual_predictions"))


@query("predict_requests_own")
def predict_requests_own(t: Tables) -> DataFrame:
    """The same with six models for each request, of its own 100 noisy rows."""
    out = forecast.predict_requests(asked(t), sources(t), scope="entity")
    return out.select("request_id", "player", "status", "target_stat", "prediction", "confidence", "usage_rate", "game_context.*", F.to_json("individual_predictions").alias("individual_predictions"))


@query("result_record", f"WITH {PLAIN_SQL} SELECT c_custkey AS request_id, CAST(c_custkey AS VARCHAR) AS player, round(pts, 6) AS prediction, round(usage_rate, 6) AS usage_rate, CAST(is_home AS INT) AS is_home, spread, total, round(reb, 6) AS a_model FROM f")
def result_record(t: Tables) -> DataFrame:
    f = features(t).select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").cast("string").alias("name"), F.lit("ok").alias("status"), F.lit("points").alias("stat"), F.round("pts", 6).alias("prediction"), F.lit(60.0).alias("confidence"), F.round("usage_rate", 6).alias("usage_rate"), F.lit("X").alias("opponent"), "is_home", "spread", "total", F.create_map(F.lit("a"), F.round("reb", 6)).alias("individual_predictions"))
    out = forecast.result_record(f)
    return out.select("request_id", "player", "prediction", "usage_rate", "game_context.is_home", "game_context.spread", "game_context.total", F.col("individual_predictions")["a"].alias("a_model"))


@query("entity_linear", """WITH x AS (SELECT o_custkey, o_totalprice / 3.14159 AS y, (year(o_orderdate) - 1995)::DOUBLE AS a FROM orders), m AS (SELECT o_custkey, count(*) AS n, avg(a) AS ma, avg(y) AS my, covar_pop(a, y) AS c, var_pop(a) AS v FROM x GROUP BY 1)
  SELECT o_custkey, n, round(CASE WHEN v > 1e-9 THEN c / v ELSE 0 END, 2) + 0.0 AS slope, round(my - CASE WHEN v > 1e-9 THEN c / v ELSE 0 END * ma, 1) + 0.0 AS intercept FROM m""")
def entity_linear(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", (F.col("o_totalprice") / 3.14159).alias("y"), (F.year("o_orderdate") - 1995).cast("double").alias("a"))
    out = models.entity_affine(rows, "o_custkey", ["a"], "y")
    return out.select("o_custkey", "n", (F.round(F.get("coefficients", F.lit(0)), 2) + 0.0).alias("slope"), (F.round("intercept", 1) + 0.0).alias("intercept"))



