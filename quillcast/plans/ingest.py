"""Ingest plans: games and rosters from page tables, the slate of a day, and the daily refresh."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcast.functions import text as ft
from quillcast.operators import schedule
from quillcast.sources import sinks
from quillcast.sources.pages import table_rows
from quillcast.sources.tables import materialize

#: Ids of the tables and links, and where a roster's columns stand.
SCHEDULE, ROSTER = "schedule", "roster"
BOX_SCORE, BOX_LINK, PLAYER_LINK = "box_score_text", r"/boxscores/(\w+)\.html", r"/players/\w/(\w+)\.html"
ROSTER_CELLS = {"position": 2, "jersey": 0, "height": 3, "weight": 4, "birth_date": 5, "experience": 7, "college": 8}


def _rows(pages: DataFrame, table: str, least: int) -> DataFrame:
    """Rows, of `least` cells, of the first table of that id on each page, and the pages' errors."""
    rows = table_rows(pages).filter((F.col("table_id") == table) | F.col("error").isNotNull())
    # By a window, as with a join each page would be parsed twice.
    rows = rows.filter("page_id IS NOT NULL").withColumn("_first", F.min("table_ix").over(Window.partitionBy("page_id")))
    return rows.filter(((F.col("table_ix") == F.col("_first")) & (F.size("cells") >= least)) | F.col("error").isNotNull())


def _cell(k: int) -> Column:
    return F.coalesce(F.get("cells", F.lit(k)), F.lit(""))


def schedule_games(pages: DataFrame) -> DataFrame:
    """Games of pages(page_id, html): page_id, row_ix, date, visitor_team, visitor_pts, home_team, home_pts, game_id, error.

    A row needs seven cells and a date. game_id comes from the link to the box score, null without one. A page without
    the table has no rows; one that can't be read has one row with its error only: see split_errors()."""
    rows = _rows(pages, SCHEDULE, 7).filter((_cell(0) != "") | F.col("error").isNotNull())
    link = F.get("links", (F.array_position("stats", BOX_SCORE) - 1).cast("int"))
    at = {"date": 0, "visitor_team": 2, "visitor_pts": 3, "home_team": 4, "home_pts": 5}
    return rows.select("page_id", "row_ix", *(F.when(F.col("error").isNull(), _cell(k)).alias(c) for c, k in at.items()), ft.extract_id(link, BOX_LINK).alias("game_id"), "error")


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, pages that could not be read with their error)."""
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select("page_id", "error")


def roster_players(pages: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(player info, active players) of pages(page_id, html, team_abbreviation) and teams(id, full_name, abbreviation).

    A row needs six cells and a link in the second one, which gives name and id. Active players are id, full_name,
    first_name and last_name; a one-word name is a last name."""
    rows = _rows(pages, ROSTER, 6).filter("error IS NULL").filter(F.get("links", F.lit(1)).isNotNull())
    rows = rows.join(pages.select("page_id", "team_abbreviation"), "page_id").join(teams.withColumnsRenamed({"id": "team_id", "full_name": "team_name"}), F.col("team_abbreviation") == F.col("abbreviation"))
    info = rows.select(
        ft.extract_id(F.get("links", F.lit(1)), PLAYER_LINK).alias("player_id"), F.coalesce(F.get("anchors", F.lit(1)), F.lit("")).alias("player_name"),
        "team_id", "team_abbreviation", "team_name", *(_cell(k).alias(c) for c, k in ROSTER_CELLS.items()),
    )
    first, last = ft.split_name(F.col("player_name"))
    return info, info.select(F.col("player_id").alias("id"), F.col("player_name").alias("full_name"), first.alias("first_name"), last.alias("last_name"))


def todays_games(games: DataFrame, teams: DataFrame, as_of: str) -> DataFrame:
    """Games of one day with HOME_TEAM_ID and VISITOR_TEAM_ID, null for unknown names."""
    ids = teams.select("full_name", F.col("id").cast("long").alias("_id"))
    out = schedule.slate(games, "date", as_of)
    for side in ("home", "visitor"):
        out = out.join(ids, F.col(f"{side}_team") == F.col("full_name"), "left").withColumnRenamed("_id", f"{side.upper()}_TEAM_ID").drop("full_name")
    return out


def refresh(players: DataFrame, pages: DataFrame, teams: DataFrame, as_of: str, base: str, season: int, source: str, hours: float = 24, now: datetime | None = None) -> DataFrame:
    """The daily refresh under the folder `base`: schedule (kept for `hours`, then built again; the old one serves if that
    fails), todays_games as JSON and CSV (empty if there are none), page_errors if there are any, and a row of metadata, which is returned."""
    spark = pages.sparkSession
    games = materialize(spark, lambda: schedule_games(pages), f"{base}/schedule", hours)
    if games is None:
        games = schedule_games(pages.limit(0))
    good, bad = split_errors(games)
    sinks.write_dual(todays_games(good, teams, as_of), f"{base}/todays_games")
    sinks.write_unless_empty(bad, f"{base}/page_errors")
    return sinks.append_metadata(players, f"{base}/metadata", season, source, now)
