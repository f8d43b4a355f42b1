"""Queries for scans, sinks, cleaning, scalar functions, windows and ingest plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.functions import text as ft
from quillcast.functions import values as fv
from quillcast.operators import clean, rolling, schedule, split_scale
from quillcast.plans import rolling_log
from quillcast.plans.catalog import Tables, query
from quillcast.sources import odds, pages, sinks, snapshots, tables

#: A total order of lineitem.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


@query("two_column_scan", "SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS position FROM nation WHERE n_name IS NOT NULL AND n_nationkey IS NOT NULL")
def two_column_scan(t: Tables) -> DataFrame:
    rows = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("position"))
    return tables.two_columns(rows, "name", "position")


@query("freshness_flag")
def freshness_flag(t: Tables) -> DataFrame:
    return tables.with_freshness(t.nation).select("n_nationkey", "is_stale")


@query("html_list_items", """SELECT page_id, CAST(i - 1 AS INT) AS pos, hrefs[i] AS href FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS hrefs FROM pages))""")
def html_list_items(t: Tables) -> DataFrame:
    return pages.list_links(t.pages)


@query("html_tables")
def html_tables(t: Tables) -> DataFrame:
    # The list items of each page as a table of one cell each, read by the table reader.
    as_table = F.regexp_replace(F.regexp_replace("html", "<li>", "<table><tr><td>"), "</li>", "</td></tr></table>")
    return pages.table_rows(t.pages.withColumn("html", as_table))


@query("page_union", """SELECT page_id, 'link' AS kind, hrefs[i] AS value FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS hrefs FROM pages)) UNION ALL SELECT page_id, 'url' AS kind, url AS value FROM pages""")
def page_union(t: Tables) -> DataFrame:
    links = pages.list_links(t.pages).select("page_id", F.lit("link").alias("kind"), F.col("href").alias("value"))
    return links.unionByName(t.pages.select("page_id", F.lit("url").alias("kind"), F.col("url").alias("value")))


@query("run_metadata", "SELECT count(*) AS n_rows, CAST(2026 AS INT) AS season, 'customer' AS source FROM customer")
def run_metadata(t: Tables) -> DataFrame:
    return sinks.run_metadata(t.customer, 2026, "customer")


@query("result_json", """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_acctbal":' || CAST(c_acctbal AS VARCHAR) || '}' AS result FROM customer""")
def result_json(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", sinks.as_json("c_custkey", "c_name", "c_acctbal").alias("result"))


@query("rename_project", "SELECT p_partkey AS id, p_name AS full_name, p_type AS position FROM part")
def rename_project(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_type").withColumnsRenamed({"p_partkey": "id", "p_name": "full_name", "p_type": "position"})


@query("drop_optional", "SELECT p_partkey, p_name, p_type, p_size, p_retailprice FROM part")
def drop_optional(t: Tables) -> DataFrame:
    return clean.drop_columns(t.part, "p_brand", "RK", "#")


@query("header_clean", 'SELECT s_suppkey AS suppkey, s_name AS name, s_acctbal AS acctbal FROM supplier')
def header_clean(t: Tables) -> DataFrame:
    raw = t.supplier.select(F.col("s_suppkey").alias("Sort: suppkey"), F.col("s_name").alias("level|name"), F.col("s_acctbal").alias("top|Sort: acctbal"))
    return clean.clean_header(raw)


@query("drop_header_rows", "SELECT event_id, event_type FROM events WHERE event_type IS DISTINCT FROM 'error'")
def drop_header_rows(t: Tables) -> DataFrame:
    return clean.drop_header_rows(t.events.select("event_id", "event_type"), "event_type", "error")


@query("drop_nulls", "SELECT event_id, nullif(event_type, 'view') AS kind FROM events WHERE nullif(event_type, 'view') IS NOT NULL")
def drop_nulls(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("kind")).na.drop(subset=["kind"])


@query("category_filter", "SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO'")
def category_filter(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_type") == "PROMO").select("p_partkey", "p_name")


@query("partition_pick", "SELECT p_partkey, p_type FROM part WHERE p_type = 'LARGE'")
def partition_pick(t: Tables) -> DataFrame:
    """From a snapshot stored by p_type: the files of one folder are read."""
    path = tables.scratch(t.spark)
    snapshots.publish(t.part.select("p_partkey", "p_type").repartition("p_type"), path, ("p_type",))
    stored = snapshots.read(t.spark, path)
    return tables.partition_of(t.part.select("p_partkey", "p_type").limit(0) if stored is None else stored, "p_type", "LARGE").select("p_partkey", "p_type")


@query("slate_for_date", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'")
def slate_for_date(t: Tables) -> DataFrame:
    return schedule.slate(t.orders, "o_orderdate", "1998-10-03").select("o_orderkey", "o_custkey")


@query("row_shape_filter", r"SELECT doc_id, len(string_split(text, chr(10))) AS n_cells FROM documents WHERE len(string_split(text, chr(10))) >= 3 AND string_split(text, chr(10))[2] <> ''")
def row_shape_filter(t: Tables) -> DataFrame:
    cells = F.split("text", "\n")
    return t.documents.filter((F.size(cells) >= 3) & (F.get(cells, 1) != "")).select("doc_id", F.size(cells).cast("long").alias("n_cells"))


EVENT_JSON = """concat('{"matches":[{"home_team":"', event_type, '","away_team":"', case when event_id % 7 = 0 then '' else concat('u', user_id) end, '","date":"d","markets":{"spreads":',
 case when event_id % 2 = 0 then concat('[', '{"home_handicap":', get_json_object(props, '$.k'), ',"home_odds":-110}', ']') else concat('{"home_handicap":', get_json_object(props, '$.k'), ',"home_odds":-110}') end,
 ',"totals":[{"total":', event_id % 3, '}]}}]}')"""


@query("odds_flatten", """SELECT event_type AS home_team, 'u' || user_id AS away_team, 'd' AS date, 'basketball' AS sport,
  nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS home_spread, -110.0::DOUBLE AS home_spread_odds, NULL::DOUBLE AS away_spread, NULL::DOUBLE AS away_spread_odds,
  nullif(CAST(event_id % 3 AS DOUBLE), 0) AS total_line, NULL::DOUBLE AS over_odds, NULL::DOUBLE AS under_odds FROM events WHERE event_id % 7 <> 0""")
def odds_flatten(t: Tables) -> DataFrame:
    raw = t.events.select(F.expr(EVENT_JSON).alias("value"))
    return odds.flatten(odds.matches(raw))


@query("odds_parse", """SELECT '{"away_team":"' || CASE WHEN event_id % 7 = 0 THEN '' ELSE 'u' || user_id END || '","date":"d","home_team":"' || event_type || '","markets":{"spreads":' || CASE WHEN event_id % 2 = 0 THEN '[' ELSE '' END
  || '{"home_handicap":' || json_extract_string(props, '$.k') || ',"home_odds":-110}' || CASE WHEN event_id % 2 = 0 THEN ']' ELSE '' END || ',"totals":[{"total":' || event_id % 3 || '}]}}' AS match FROM events""")
def odds_parse(t: Tables) -> DataFrame:
    return odds.matches(t.events.select(F.expr(EVENT_JSON).alias("value"))).select(F.expr("to_json(match)").alias("match"))


@query("request_validation", """SELECT c_custkey, c_name, CASE WHEN trim(coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_name END, '')) = '' THEN 'no name' WHEN c_custkey % 11 = 0 THEN 'no spread' END AS reason,
  c_custkey % 5 <> 0 AND c_custkey % 11 <> 0 AS is_valid FROM customer""")
def request_validation(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")).alias("spread"))
    return clean.split_valid(rows, ["name"], ["spread"]).select("c_custkey", "c_name", "reason", "is_valid")


@query("name_suggest", "SELECT p_name, p_partkey FROM part WHERE contains(lower(p_name), 'bolt') ORDER BY p_name, p_partkey LIMIT 10")
def name_suggest(t: Tables) -> DataFrame:
    return t.part.filter(F.contains(F.lower("p_name"), F.lit("bolt"))).orderBy("p_name", "p_partkey").limit(10).select("p_name", "p_partkey")


@query("top_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_n(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("union_sources", "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_sources(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("column_proxy", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS fga, CAST(p_retailprice AS DOUBLE) AS fta, 0.0::DOUBLE AS fg3a FROM part")
def column_proxy(t: Tables) -> DataFrame:
    p = t.part
    return p.select("p_partkey", fv.first_present(p, ["FGA", "p_size"]).alias("fga"), fv.first_present(p, ["p_retailprice", "FTM"]).alias("fta"), fv.first_present(p, ["3PA", "3PM"]).alias("fg3a"))


@query("strip_accents", r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS plain FROM documents")
def strip_accents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ft.strip_accents(F.col("text")).alias("plain"))


@query("normalize_name", r"SELECT doc_id, coalesce(trim(upper(regexp_replace(strip_accents(string_split(text, '.')[1]), '[^\x00-\x7F]', '', 'g'))), '') AS name FROM documents")
def normalize_name(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ft.normalize_name(F.split("text", r"\.")[0]).alias("name"))


TAGS_SQL = ", ".join(f"'{x}'" for x in ft.STATUS_TAGS)


@query("clean_entity_name", rf"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(string_split(s, '(')[1], '^["'']+|["'']+$', '', 'g')), '\s+'), lambda x: x <> '' AND x NOT IN ({TAGS_SQL})), ' ') AS name
  FROM (SELECT doc_id, '"' || string_split(text, '.')[1] || '  FA OUT" (' || lang || ')' AS s FROM documents)""")
def clean_entity_name(t: Tables) -> DataFrame:
    dirty = F.concat(F.lit('"'), F.split("text", r"\.")[0], F.lit('  FA OUT" ('), "lang", F.lit(")"))
    return t.documents.select("doc_id", ft.clean_entity_name(dirty).alias("name"))


@query("first_token", "SELECT p_partkey, string_split(p_name, ' ')[1] AS token FROM part")
def first_token(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", ft.first_token(F.concat(F.lit(" "), "p_name")).alias("token"))


@query("split_name", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first_name, string_split(p_name, ' ')[-1] AS last_name FROM part")
def split_name(t: Tables) -> DataFrame:
    first, last = ft.split_name(F.col("p_name"))
    return t.part.select("p_partkey", first.alias("first_name"), last.alias("last_name"))


@query("coerce_numeric", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS bad FROM events")
def coerce_numeric(t: Tables) -> DataFrame:
    return t.events.select("event_id", fv.to_number(F.get_json_object("props", "$.k")).alias("k"), fv.to_number(F.col("event_type")).alias("bad"))


@query("coerce_all_except", "SELECT p_name, CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(NULL AS DOUBLE) AS p_brand, CAST(p_size AS DOUBLE) AS p_size FROM part")
def coerce_all_except(t: Tables) -> DataFrame:
    return clean.coerce_except(t.part.select("p_name", "p_partkey", "p_brand", "p_size"), "p_name")


@query("safe_float", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, 0.0::DOUBLE AS bad FROM events")
def safe_float(t: Tables) -> DataFrame:
    return t.events.select("event_id", fv.safe_float(F.get_json_object("props", "$.k")).alias("k"), fv.safe_float(F.col("event_type")).alias("bad"))


@query("clean_stats", f"SELECT {LINE_ORDER_SQL}, l_quantity AS pts, CAST(l_linenumber AS DOUBLE) AS reb, CAST(l_discount AS VARCHAR) AS pct, 'S' || l_suppkey AS team FROM lineitem")
def clean_stats(t: Tables) -> DataFrame:
    dirty = t.lineitem.select(
        *LINE_ORDER, F.concat_ws(" ", F.col("l_quantity").cast("string"), F.lit("12")).alias("PTS"), F.concat(F.col("l_linenumber").cast("string"), F.lit(" 3")).alias("REB"),
        F.col("l_discount").cast("string").alias("pct"), F.concat(F.lit("S"), F.col("l_suppkey"), F.lit(" x")).alias("TEAM"),
    )
    return clean_positions(dirty, ["PTS", "REB", "AST"]).select(*LINE_ORDER, F.col("PTS").alias("pts"), F.col("REB").alias("reb"), "pct", F.col("TEAM").alias("team"))


def clean_positions(df: DataFrame, stats: list[str], team: str = "TEAM") -> DataFrame:
    """The first word of the stat columns that exist, as numbers, and of the team; other columns stay text."""
    return df.withColumns({c: fv.to_number(ft.first_token(F.col(c))) for c in stats if c in df.columns} | {team: ft.first_token(F.col(team))})


CATEGORIES = {"ECONOMY": "SG", "SMALL": "SF", "LARGE": "C"}


@query("primary_category", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'SG' WHEN 'SMALL' THEN 'SF' WHEN 'LARGE' THEN 'C' ELSE p_type END AS position FROM part")
def primary_category(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", ft.primary_category(F.concat(F.lit(" "), "p_type", F.lit("-X")), CATEGORIES).alias("position"))


@query("extract_id", r"SELECT page_id, nullif(regexp_extract(url, '/(\d+)', 1), '') AS id FROM pages")
def extract_id(t: Tables) -> DataFrame:
    return t.pages.select("page_id", ft.extract_id(F.col("url"), r"/(\d+)").alias("id"))


@query("parse_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d1, CAST(o_orderdate AS DATE) AS d2, CAST(NULL AS DATE) AS bad FROM orders")
def parse_dates(t: Tables) -> DataFrame:
    long = F.concat(F.date_format("o_orderdate", "E"), F.lit(", "), F.date_format("o_orderdate", "MMM d, yyyy"))
    return t.orders.select("o_orderkey", fv.parse_date(long).alias("d1"), fv.parse_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("d2"), fv.parse_date(F.col("o_orderpriority")).alias("bad"))


@query("format_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y%m%d') AS compact FROM orders")
def format_dates(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "yyyyMMdd").alias("compact"))


@query("truthy_coalesce", "SELECT event_id, coalesce(nullif(k % 3, 0), nullif(k % 2, 0), 0) AS v FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def truthy_coalesce(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", fv.truthy(k % 3, k % 2, F.lit(0).cast("long")).alias("v"))


@query("coalesce_id", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'G' || event_id END, CASE WHEN event_id % 3 = 1 THEN 'g' || event_id END, '') AS game_id FROM events")
def coalesce_id(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select(e, F.coalesce(F.when(e % 3 == 0, F.concat(F.lit("G"), e)), F.when(e % 3 == 1, F.concat(F.lit("g"), e)), F.lit("")).alias("game_id"))


@query("clamp", "SELECT c_custkey, greatest(c_acctbal, 0) AS floored, least(99, greatest(60, c_acctbal / 100)) AS bounded, least(c_acctbal, 0.3) AS capped FROM customer")
def clamp(t: Tables) -> DataFrame:
    a = F.col("c_acctbal")
    return t.customer.select("c_custkey", fv.clamp(a, 0.0).alias("floored"), fv.clamp(a / 100, 60.0, 99.0).alias("bounded"), fv.clamp(a, None, 0.3).alias("capped"))


TARGETS = {"Household": "pts", "Machinery": "reb", "Furniture": "ast"}


@query("target_map", "SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'household' THEN 'pts' WHEN 'machinery' THEN 'reb' WHEN 'furniture' THEN 'ast' END AS target FROM customer")
def target_map(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", ft.mapped(F.initcap(F.lower("c_mktsegment")), TARGETS).alias("target"))


@query("signed_label", "SELECT c_custkey, CASE WHEN round(c_acctbal) > 0 THEN '+' ELSE '' END || CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) AS spread, CASE WHEN c_nationkey % 2 = 1 THEN 'Home' ELSE 'Away' END AS place FROM customer")
def signed_label(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", ft.signed_text(F.round("c_acctbal").cast("long")).alias("spread"), F.when(F.col("c_nationkey") % 2 == 1, "Home").otherwise("Away").alias("place"))


@query("dedupe_first", f"SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) AS n FROM lineitem) WHERE n = 1")
def dedupe_first(t: Tables) -> DataFrame:
    return clean.keep_first(t.lineitem.select(*LINE_ORDER, "l_quantity"), ["l_orderkey"], *LINE_ORDER).select("l_orderkey", "l_partkey", "l_quantity")


@query("dedupe_last", f"SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) AS n FROM lineitem) WHERE n = 1")
def dedupe_last(t: Tables) -> DataFrame:
    return clean.keep_last(t.lineitem.select(*LINE_ORDER, "l_quantity"), ["l_orderkey"], *LINE_ORDER[1:]).select("l_orderkey", "l_partkey", "l_quantity")


@query("rolling_avg", "SELECT event_id, user_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS value_roll_avg FROM events")
def rolling_avg(t: Tables) -> DataFrame:
    return rolling.rolling_means(t.events.select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], ["value", "minutes"]).select("event_id", "user_id", "value_roll_avg")


@query("rolling_latest", """SELECT o_custkey, round(avg(o_totalprice), 4) AS o_totalprice_roll_avg, count(*) AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
  WHERE n <= 5 GROUP BY o_custkey""")
def rolling_latest(t: Tables) -> DataFrame:
    out = rolling.latest_means(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    return out.select("o_custkey", F.round("o_totalprice_roll_avg", 4).alias("o_totalprice_roll_avg"), "n_rows")


def _events_by_batches(t: Tables) -> str:
    """The events as a growing log of five batches by time; its folder."""
    log = t.events.select("event_id", "user_id", "ts", "value")
    day = F.unix_date(F.to_date("ts"))
    first, last = log.agg(F.min(day), F.max(day)).first()
    path = tables.scratch(t.spark)
    span = ((last or 0) - (first or 0)) // 5 + 1
    batch = F.coalesce(F.floor((day - (first or 0)) / span), F.lit(0))
    for k in range(5):
        rolling_log.append(log.filter(batch == k), path, "user_id", ["ts", "event_id"], ["value"])
    return path


@query("rolling_appended", "SELECT event_id, user_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS value_roll_avg FROM events")
def rolling_appended(t: Tables) -> DataFrame:
    return rolling_log.rows(t.spark, _events_by_batches(t)).select("event_id", "user_id", "value_roll_avg")


@query("rolling_state", """SELECT user_id, max(ts) AS last_ts, arg_max(roll, n) AS value_roll_avg, count(*) AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS roll FROM events) WHERE back <= 5 GROUP BY user_id""")
def rolling_state(t: Tables) -> DataFrame:
    last = rolling_log.state(t.spark, _events_by_batches(t))
    return last.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max_by("value_roll_avg", F.struct("ts", "event_id")).alias("value_roll_avg"), F.count("*").alias("n_rows"))


@query("rolling_chunked", "SELECT event_id, user_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS value_roll_avg FROM events")
def rolling_chunked(t: Tables) -> DataFrame:
    log = t.events.select("event_id", "user_id", "ts", "value")
    return rolling.rolling_means_chunked(log, "user_id", ["ts", "event_id"], ["value", "minutes"], F.to_date("ts")).select("event_id", "user_id", "value_roll_avg")


SPLIT_KEYS = LINE_ORDER[1:4]
SPLIT_HASH = "md5(concat_ws(':', '42', CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)))"


@query("exact_split", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n <= ceil(0.2 * c) AS is_test FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SPLIT_HASH}, l_linenumber, l_partkey, l_suppkey) AS n,
  count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)""")
def exact_split(t: Tables) -> DataFrame:
    return split_scale.exact_split(t.lineitem.select("l_orderkey", *SPLIT_KEYS), "l_orderkey", SPLIT_KEYS)


@query("group_summary", """SELECT p.p_type, n_rows, p_partkey, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) p JOIN (SELECT p_type, count(*) AS n_rows FROM part GROUP BY p_type) g ON g.p_type = p.p_type WHERE n <= 5""")
def group_summary(t: Tables) -> DataFrame:
    return clean.group_summary(t.part.select("p_type", "p_partkey"), "p_type", 5, "p_partkey").select("p_type", "n_rows", "p_partkey", "rank")


def usage_table(raw: DataFrame, name: str, team: str, rate: str, *order: str) -> DataFrame:
    """Cleaned usage rates: header rows out, the rate as a number, the first row of each name, then no null rates.

    A name whose first row has no rate is gone: the duplicate goes before the null."""
    rows = clean.drop_header_rows(raw, name, "Player").withColumn(rate, fv.to_number(F.col(rate)))
    return clean.keep_first(rows, [name], *order).na.drop(subset=[rate]).select(name, team, rate)


@query("ingest_usage", f"""SELECT PLAYER, Team, USGPCT FROM (SELECT l_partkey AS PLAYER, 'T' || l_suppkey AS Team, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS USGPCT,
  row_number() OVER (PARTITION BY l_partkey ORDER BY {LINE_ORDER_SQL}) AS n FROM lineitem) WHERE n = 1 AND USGPCT IS NOT NULL""")
def ingest_usage(t: Tables) -> DataFrame:
    raw = t.lineitem.select(
        *LINE_ORDER, F.col("l_partkey").cast("string").alias("Sort: PLAYER"), F.concat(F.lit("T"), "l_suppkey").alias("info|Team"),
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("USG%"),
    )
    rows = clean.clean_header(raw).withColumnsRenamed({"USG%": "USGPCT"})
    return usage_table(rows, "PLAYER", "Team", "USGPCT", *LINE_ORDER).select(F.col("PLAYER").cast("long").alias("PLAYER"), "Team", "USGPCT")


@query("ingest_averages", """SELECT name, MIN, PTS FROM (SELECT s_name AS name, s_acctbal AS MIN, CAST(s_nationkey AS DOUBLE) AS PTS, row_number() OVER (PARTITION BY s_name ORDER BY s_suppkey) AS n FROM supplier) WHERE n = 1""")
def ingest_averages(t: Tables) -> DataFrame:
    raw = t.supplier.select(F.col("s_suppkey").alias("RK"), F.concat("s_name", F.lit(" (T - G) DTD")).alias("Player"), F.col("s_acctbal").cast("string").alias("MIN"), F.col("s_nationkey").cast("string").alias("PTS"))
    rows = clean.drop_header_rows(raw, "Player").withColumn("name", ft.clean_entity_name(F.col("Player")))
    numbers = clean.coerce_except(rows.drop("Player"), "name")
    return clean.drop_columns(clean.keep_first(numbers, ["name"], "RK"), "RK", "#")


@query("ingest_defense", """SELECT p_type AS position, l_suppkey AS team, round(avg(l_quantity), 6) AS pts FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE') GROUP BY 1, 2""")
def ingest_defense(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).filter(F.col("p_type").isin("ECONOMY", "SMALL", "LARGE"))
    dirty = rows.select(F.col("p_type").alias("position"), F.concat("l_suppkey", F.lit(" rank")).alias("TEAM"), F.concat_ws(" ", F.col("l_quantity").cast("string"), F.lit("7")).alias("PTS"))
    out = clean_positions(dirty, ["PTS", "REB"]).groupBy("position", "TEAM").agg(F.round(F.avg("PTS"), 6).alias("pts"))
    return out.select("position", F.col("TEAM").cast("long").alias("team"), "pts")


@query("ingest_roster", r"""SELECT nullif(regexp_extract(hrefs[i], '/([^/]+)$', 1), '') AS player_id, page_id, host FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i, regexp_extract(url, '://([^/]+)', 1) AS host
  FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS hrefs FROM pages))""")
def ingest_roster(t: Tables) -> DataFrame:
    links = pages.list_links(t.pages).select("page_id", ft.extract_id(F.col("href"), "/([^/]+)$").alias("player_id"))
    teams = t.pages.select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    return links.join(teams, "page_id").select("player_id", "page_id", "host")


@query("ingest_schedule", """SELECT page_id, count(*) AS n_games, min(href) AS first_game FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS href FROM pages) WHERE href <> '' GROUP BY page_id""")
def ingest_schedule(t: Tables) -> DataFrame:
    links = pages.list_links(t.pages).filter(F.col("href") != "")
    return links.groupBy("page_id").agg(F.count("*").alias("n_games"), F.min("href").alias("first_game"))


@query("ingest_slate", """SELECT o_orderkey AS game_id, 'NATION_' || c_nationkey AS home, c_nationkey AS home_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'""")
def ingest_slate(t: Tables) -> DataFrame:
    games = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    games = games.select(F.col("o_orderkey").alias("game_id"), F.col("n_name").alias("home"), F.date_format("o_orderdate", "MMM d, yyyy").alias("date"))
    today = clean.drop_columns(schedule.slate(games, "date", "1998-10-03"), "date", "date_parsed")
    return schedule.name_to_id(today, "home", t.nation, "n_name", "n_nationkey", "home_id").select("game_id", "home", F.col("home_id").cast("int").alias("home_id"))


@query("team_dimension", "SELECT n_nationkey AS id, n_name AS full_name, upper(substr(r_name, 1, 3)) AS abbreviation FROM nation JOIN region ON n_regionkey = r_regionkey")
def team_dimension(t: Tables) -> DataFrame:
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("full_name"), F.upper(F.substring("r_name", 1, 3)).alias("abbreviation"))
