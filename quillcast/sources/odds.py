"""Nested odds documents to flat records, by variant paths (a market may be a list, an object or absent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a match, of a market, and of the numbers in it, each list in the order in which they are tried.
HOME, AWAY, DATE = ["home_team", "home", "homeTeam"], ["away_team", "away", "awayTeam"], ["date", "start_time", "datetime"]
MARKETS, SPREADS, TOTALS = ["markets", "odds"], ["spreads", "spread"], ["totals", "total"]
NUMBERS = {
    "home_spread": ("_spread", ["home_handicap", "home_line", "handicap"]),
    "home_spread_odds": ("_spread", ["home_odds", "odds_home"]),
    "away_spread": ("_spread", ["away_handicap", "away_line"]),
    "away_spread_odds": ("_spread", ["away_odds", "odds_away"]),
    "total_line": ("_total", ["total", "line", "total_line"]),
    "over_odds": ("_total", ["over_odds", "over"]),
    "under_odds": ("_total", ["under_odds", "under"]),
}
WRAPPERS = ("data", "matches", "events")
#: What counts as missing, as JSON.
FALSY = ("null", "false", "0", "0.0", '""', "[]", "{}")


def matches(raw: DataFrame, text: str = "value") -> DataFrame:
    """The match documents (variant `match`) in raw JSON texts: a bare list, or a list under the first wrapper key
    that is present, even if it is empty. A null, blank or broken text has none."""
    # explode() of one element: what it holds is evaluated once, whatever is made of it above.
    v = raw.select(F.explode(F.array(F.try_parse_json(F.trim(F.col(text))))).alias("v")).filter("v IS NOT NULL")
    picked = F.coalesce(*(F.try_variant_get("v", f"$.{w}", "variant") for w in WRAPPERS), F.col("v"))
    return v.select(picked.alias("list")).selectExpr("explode(coalesce(try_variant_get(list, '$', 'array<variant>'), array())) AS match")


def _get(v: str, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _there(v: Column) -> Column:
    """A variant, null where it counts as missing."""
    return F.when(~F.to_json(v).isin(*FALSY), v)


def flatten(docs: DataFrame, sport: str = "basketball", zero_is_value: bool = False) -> DataFrame:
    """One flat record for each match that has both teams; absent markets are null.

    Every field has several keys; the first with a value counts, and of a list of markets the first element. A 0 counts
    as missing, unless it stands under the last key of its field or zero_is_value is set."""

    def text(keys: list[str]) -> Column:
        return F.coalesce(*(F.nullif(_get("match", k, "string"), F.lit("")) for k in keys[:-1]), _get("match", keys[-1], "string"))

    def number(v: str, keys: list[str]) -> Column:
        tried = [_get(v, k, "double") for k in keys]
        return F.coalesce(*(c if zero_is_value else F.nullif(c, F.lit(0.0)) for c in tried[:-1]), tried[-1])

    def first(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)

    out = docs.select("match", F.explode(F.array(F.coalesce(*(_there(_get("match", k)) for k in MARKETS)))).alias("_markets"))
    markets = [F.coalesce(*(_there(_get("_markets", k)) for k in keys)).alias(name) for name, keys in (("_spread", SPREADS), ("_total", TOTALS))]
    out = out.select("match", F.explode(F.array(F.struct(*markets))).alias("_m"))
    out = out.select("match", F.explode(F.array(F.struct(first(F.col("_m._spread")).alias("_spread"), first(F.col("_m._total")).alias("_total")))).alias("_m"))
    out = out.select("match", "_m._spread", "_m._total")
    out = out.select(
        text(HOME).alias("home_team"), text(AWAY).alias("away_team"), text(DATE).alias("date"), F.lit(sport).alias("sport"),
        *(number(v, keys).alias(name) for name, (v, keys) in NUMBERS.items()),
    )
    return out.filter((F.coalesce("home_team", F.lit("")) != "") & (F.coalesce("away_team", F.lit("")) != ""))
