"""From names to answers, the ingest plans and the models of one entity, on small fixtures."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcast.operators import boosting, models, resolve
from quillcast.operators.augment import FEATURES
from quillcast.plans import forecast, ingest
from quillcast.sources import odds, sinks


def test_odds_under_every_key(spark):
    raw = [
        '{"events":[{"home":"A","away":"B","start_time":"t","odds":{"spread":{"home_line":-3.5,"odds_home":-110,"away_line":3.5,"odds_away":-105},"total":[{"line":220,"over":1.9,"under":1.8}]}}]}',
        '[{"homeTeam":"C","awayTeam":"D","datetime":"u","markets":{},"odds":{"spreads":[{"handicap":0}],"totals":{"total":0,"total_line":210}}}]',
        '[{"home_team":"","home":"E","away_team":"F","markets":{"spreads":[],"spread":[{"home_handicap":0,"handicap":2}]}}]',
    ]
    got = {r.home_team: r for r in odds.flatten(odds.matches(spark.createDataFrame([(r,) for r in raw], "value string"))).collect()}
    assert tuple(got["A"])[1:] == ("B", "t", "basketball", -3.5, -110.0, 3.5, -105.0, 220.0, 1.9, 1.8)
    # A 0 under the last key of its field is a value; an empty market gives way to the other key.
    assert (got["C"].date, got["C"].home_spread, got["C"].total_line) == ("u", 0.0, 210.0)
    assert (got["E"].home_spread, got["E"].total_line) == (2.0, None)


def test_containing_by_brute_force(spark):
    import random

    rng = random.Random(5)
    names = ["".join(rng.choice("ABC ") for _ in range(rng.randrange(0, 12))) for _ in range(150)]
    needles = ["".join(rng.choice("ABC ") for _ in range(rng.randrange(0, 6))) for _ in range(80)]
    got = resolve.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in needles for b in names if a and a in b}


def test_last_word_skips_suffixes(spark):
    ref = spark.createDataFrame([("p1", "Gary Trent Jr.", 1), ("p2", "Jaren Jackson", 2)], "id string, name string, o int")
    q = spark.createDataFrame([("Michael Jackson Jr.",)], "q string")
    assert resolve.resolve(q, ref, "q", "name", "o").first().match.id == "p1"
    assert resolve.resolve(q, ref, "q", "name", "o", skip=("JR.", "SR.")).first().match.id == "p2"


def test_first_mode_of_team_matches(spark):
    ref = spark.createDataFrame([("PG", "SAC", 20.0, 1), ("PG", "SA", 30.0, 2)], "position string, team string, pts double, o int")
    asked = spark.createDataFrame([("PG", "SAS", "SA")], "position string, key string, alias string")
    assert resolve.prefer_exact(asked, ref, "position", "key", "alias", "team", {"pts": 45.0}, "o", mode="first").first().pts == 20.0


def test_position_chain(spark):
    positions = spark.createDataFrame([("Luka Dončić", "PG", 1), ("luka doncic", " SF", 2)], "name string, position string, o int")
    info = spark.createDataFrame([("LeBron James", "F-G", 1), ("Bronny James", "G", 2), ("Al Horford", None, 3)], "name string, position string, o int")
    q = spark.createDataFrame([("LUKA DONCIC",), ("LeBron James",), ("Somebody James",), ("Al Horford",), ("Nobody",), (None,)], "q string")
    got = {r.q: r.position for r in resolve.positions_of(q, "q", positions, info).collect()}
    assert got == {"LUKA DONCIC": "SF", "LeBron James": "SF", "Somebody James": "SF", "Al Horford": "SG", "Nobody": "SG", None: "SG"}


def test_recent_averages_and_season_rows(spark):
    averages = spark.createDataFrame([("LeBron James", 25.0, 7.0, None, 3.0, 5.0, 4.0, 1)], "Player string, PTS double, REB double, AST double, `2PM` double, `3PM` double, FTM double, o int")
    q = spark.createDataFrame([("lebron",), ("x y",)], "q string")
    got = {r.q: r for r in resolve.recent_averages(q, averages, "q", "Player", "o").collect()}
    r = got["lebron"]
    assert (r.has_averages, r.pts_roll_avg, r.ast_roll_avg, r.fga_roll_avg, r.fg3a_roll_avg, r.fta_roll_avg, r.blk_roll_avg) == (True, 25.0, None, 3.0, 5.0, 4.0, 0.0)
    assert got["x y"].has_averages is False and got["x y"].pts_roll_avg is None
    players = spark.createDataFrame([("1", "Jokić"), ("2", "James"), ("3", "Nobody")], "id string, full_name string")
    usage = spark.createDataFrame([("LeBron JAMES", 30.0, 1), ("Bronny James", 20.0, 2), ("Nikola Jokic", 29.0, 3)], "PLAYER string, PTS double, o int")
    log = spark.createDataFrame([(9, "2026-01-02", *([1.0] * 10))], "e long, GAME_DATE string, " + ", ".join(f"{c} double" for c in resolve.SEASON))
    e = spark.createDataFrame([(1,), (2,), (3,), (9,)], "e long")
    out = resolve.log_or_season(e, "e", log, players, usage, "2026-04-09", "o").collect()
    # Accents aren't stripped here, so 1 has no row; the first James counts; what usage lacks is 0.
    assert {(r.e, str(r.GAME_DATE), r.PTS, r.TOV, r.source) for r in out} == {(2, "2026-04-09", 30.0, 0.0, "average"), (9, "2026-01-02", 1.0, 1.0, "log")}


SCHEDULE = """<table id="schedule"><tr class="thead"><th>Date</th></tr>
<tr><th>Thu, Apr 9, 2026</th><td>7p</td><td><a href="/t">Nets</a></td><td>99</td><td>Bulls</td><td>101</td><td data-stat="box_score_text"><a href="/boxscores/202604090CHI.html">Box</a></td></tr>
<tr><th>Fri, Apr 10, 2026</th><td>7p</td><td>Nets</td><td></td><td>Unknown</td><td></td><td data-stat="box_score_text"></td></tr>
<tr><th></th><td>7p</td><td>Nets</td><td></td><td>Bulls</td><td></td><td></td></tr><tr><td>short</td></tr></table>"""
ROSTER = """<table id="roster"><tr><th>7</th><td><a href="/players/d/doejo01.html">Joe Doe</a> (TW)</td><td>PG</td><td>6-1</td><td>190</td><td>May 3, 2001</td><td>us</td><td>R</td></tr>
<tr><th>8</th><td>No Link</td><td>C</td><td>7-0</td><td>250</td><td>x</td></tr><tr><th>9</th><td><a href="/x">Nene</a></td><td>C</td><td>7-0</td><td>250</td><td>x</td></tr></table>"""


def test_schedule_and_roster(spark):
    pages = spark.createDataFrame([(1, SCHEDULE, "CHI"), (2, "<p>none</p>", "BRK"), (3, None, "BRK"), (4, ROSTER, "CHI")], "page_id long, html string, team_abbreviation string")
    games, bad = ingest.split_errors(ingest.schedule_games(pages))
    assert [(r.date, r.visitor_team, r.home_team, r.home_pts, r.game_id) for r in games.orderBy("row_ix").collect()] == [("Thu, Apr 9, 2026", "Nets", "Bulls", "101", "202604090CHI"), ("Fri, Apr 10, 2026", "Nets", "Unknown", "", None)]
    assert bad.count() == 0
    teams = spark.createDataFrame([(11, "Bulls", "CHI"), (12, "Nets", "BRK")], "id long, full_name string, abbreviation string")
    info, active = ingest.roster_players(pages, teams)
    assert {(r.player_id, r.player_name, r.team_id, r.position, r.jersey, r.experience, r.college) for r in info.collect()} == {("doejo01", "Joe Doe", 11, "PG", "7", "R", ""), (None, "Nene", 11, "C", "9", "", "")}
    assert {(r.id, r.first_name, r.last_name) for r in active.collect()} == {("doejo01", "Joe", "Doe"), (None, "", "Nene")}


def test_refresh(spark, tmp_path):
    pages = spark.createDataFrame([(1, SCHEDULE)], "page_id long, html string")
    teams = spark.createDataFrame([(11, "Bulls"), (12, "Nets")], "id long, full_name string")
    players = spark.createDataFrame([(k,) for k in range(5)], "id long")
    for day, rows in (("2026-04-09", 1), ("2026-04-11", 0)):
        row = ingest.refresh(players, pages, teams, day, str(tmp_path / "cache"), 2026, "pages", now=datetime.datetime(2026, 4, 9)).first()
        assert (row.n_rows, row.season, row.source, row.last_updated) == (5, 2026, "pages", datetime.datetime(2026, 4, 9))
        today = spark.read.schema("home_team string, HOME_TEAM_ID long, VISITOR_TEAM_ID long").json(str(tmp_path / "cache" / "todays_games.json")).collect()
        assert [tuple(r) for r in today] == [("Bulls", 11, 12)] * rows
    assert spark.read.parquet(str(tmp_path / "cache" / "metadata")).count() == 2
    assert sinks.append_metadata(players.limit(0), str(tmp_path / "m"), 1, "s").first().n_rows == 0


def fixture(spark):
    info = spark.createDataFrame([("1", "Luka Dončić", 10, "PG", 1), ("2", "LeBron James", 20, "F-G", 2), ("3", "Al Horford", 30, "C", 3), ("4", "No Averages", 10, "C", 4), ("5", "Team Less", 0, "C", 5)], "player_id string, player_name string, team_id long, position string, o int")
    averages = spark.createDataFrame([("Luka Doncic", 30.0, 8.0, 9.0, 1), ("LeBron James", 25.0, None, 7.0, 2), ("Al Horford", 9.0, 6.0, 3.0, 3), ("Team Less", 1.0, 1.0, 1.0, 4)], "Player string, PTS double, REB double, AST double, o int")
    usage = spark.createDataFrame([("LUKA DONCIC", 35.0, 1)], "PLAYER string, USGPCT double, o int")
    games = spark.createDataFrame([(10, 20, 1), (20, 30, 2)], "home long, visitor long, o int")
    teams = spark.createDataFrame([(10, "DAL"), (20, "SAS")], "id long, abbreviation string")
    positions = spark.createDataFrame([("Luka Doncic", "PG", 1)], "name string, position string, o int")
    defense = spark.createDataFrame([("PG", "SAC", "1 1", "1", "1", 1), ("PG", "SA", "24.5 3", "7", "5.5", 2)], "position string, Team string, PTS string, REB string, AST string, o int")
    return forecast.Sources(info, averages, usage, games, teams, positions, defense)


ASKED = [(1, "luka doncic", "Points", 3.5, 220.0), (2, "LeBron James", "points", -3.5, 220.0), (3, "Al Horford", "Rebounds", 0.0, 210.0), (4, "No Averages", "points", 0.0, 210.0), (5, "Nobody Else", "points", 0.0, 210.0), (6, "Team Less", "points", 0.0, 1.0), (7, "luka", "blocks", 0.0, 1.0), (8, None, "points", 0.0, 1.0)]


def test_features_from_names(spark):
    got = {r.request_id: r for r in forecast.request_features(spark.createDataFrame(ASKED, "request_id long, name string, stat string, spread double, total double"), fixture(spark)).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "ok", 3: "ok", 4: "no_averages", 5: "not_found", 6: "no_game", 7: "ok", 8: "not_found"}
    r = got[1]
    assert (r.player_id, r.opponent, r.is_home, r.position, r.pts, r.mins, r.usage_rate) == ("1", "SAS", 1.0, "PG", 30.0, 0.0, 35.0)
    # The alias SA is matched exactly, before SAC that only contains it.
    assert (r.opp_pts_allowed, r.opp_reb_allowed, r.opp_ast_allowed, r.opp_fd_allowed) == (24.5, 7.0, 5.5, 24.5)
    assert (got[2].opponent, got[2].is_home, got[2].reb, got[2].usage_rate, got[2].opp_pts_allowed, got[2].opp_fd_allowed) == ("DAL", 0.0, 0.0, 20.0, 25.0, 45.0)
    assert (got[3].opponent, got[3].is_home) == ("SAS", 0.0)


def test_predictions_from_names(spark):
    asked = spark.createDataFrame(ASKED, "request_id long, name string, stat string, spread double, total double")
    got = {r.request_id: r for r in forecast.predict_requests(asked, fixture(spark), copies=40, names=["linear", "bayesian"]).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "ok", 3: "ok", 4: "no_averages", 5: "not_found", 6: "no_game", 7: "bad_stat", 8: "not_found"}
    for k in (1, 2, 3):
        r = got[k]
        assert set(r.individual_predictions) == {"linear", "bayesian"} and r.prediction == pytest.approx(np.mean(list(r.individual_predictions.values())))
        assert 60 <= r.confidence <= 99 and r.game_context.is_home in (0, 1)
    assert got[1].target_stat == "points" and got[3].target_stat == "rebounds" and all(got[k].prediction is None for k in (4, 5, 6, 7, 8))
    none = forecast.predict_requests(asked.filter("request_id = 5"), fixture(spark), names=["linear"]).first()
    assert (none.status, none.prediction, none.individual_predictions) == ("not_found", None, None)


def test_a_model_for_each_entity(spark):
    rng = np.random.default_rng(3)
    rows = [(e, *x, 5.0 * e, float(2 * x[0] - e * x[1] + e)) for e in range(1, 5) for x in rng.normal(10, 3, (30, 2)).tolist()]
    df = spark.createDataFrame(rows, "e long, a double, b double, c double, y double")
    fitted = models.entity_affine(df, "e", ["a", "b", "c"], "y")
    for r in fitted.collect():
        own = np.array([x[1:] for x in rows if x[0] == r.e])
        want = np.linalg.lstsq(np.column_stack([own[:, :2], np.ones(len(own))]), own[:, 3], rcond=None)[0]
        assert r.n == 30 and np.allclose([*r.coefficients[:2], r.intercept], want) and r.coefficients[2] == 0
    scored = models.score_affine(df, fitted, "e", ["a", "b", "c"])
    assert scored.filter(F.abs(F.col("prediction") - F.col("y")) > 1e-6).count() == 0
    assert models.entity_affine(df.limit(0), "e", ["a"], "y").count() == 0


@pytest.mark.parametrize("growth", ["level", "leaf"])
def test_boosting_with_the_same_bins_does_not_depend_on_partitions(spark, growth, monkeypatch):
    monkeypatch.setattr(boosting, "bin_edges", lambda df, features, bins, least: [np.linspace(-2, 2, bins - 1).tolist() for _ in features])
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (600, 2))
    df = spark.createDataFrame([(float(a), float(b), float(np.sin(a) + 0.3 * b)) for a, b in x], "a double, b double, y double")
    fit = boosting.fit_histogram(growth, trees=8, depth=3)
    got = [[r.prediction for r in fit(df.repartition(n, "a"), ["a", "b"], "y")(df.coalesce(1)).collect()] for n in (1, 40)]
    assert got[0] == got[1]
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1]
    assert 1 - ((np.array(got[0]) - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.5


def test_six_models_on_one_pass(spark):
    rows = [{c: float(1 + (k * (i + 3)) % 17) for i, c in enumerate(FEATURES)} | {"e": k} for k in range(6)]
    f = spark.createDataFrame(rows)
    scorers = {m: models._affine([0.0] * len(FEATURES), float(k), FEATURES) for k, m in enumerate(models.MODELS)}
    got = models.score_long(f.withColumn("prediction", F.lit(9.0)), scorers, "e")
    assert {(r.model, r.prediction) for r in got.collect()} == {(m, float(k)) for k, m in enumerate(models.MODELS)} and got.count() == 36


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([(1, '<table id="schedule"><tr>' + "<td>a</td>" * 7 + "</tr></table><table id=\"schedule\"><tr>" + "<td>b</td>" * 7 + "</tr></table>"), (None, "<p>x</p>")], "page_id long, html string")
    games = ingest.schedule_games(pages)
    assert [r.date for r in games.collect()] == ["a"]
    assert games._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_an_answer_fits_its_own_models_once(spark):
    asked = spark.createDataFrame(ASKED, "request_id long, name string, stat string, spread double, total double")
    plan = forecast.predict_requests(asked, fixture(spark), copies=10, names=["linear"], scope="entity")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
