"""Operators on small fixtures, with the edge cases of the tables they are for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcast.functions import text as ft
from quillcast.functions import values as fv
from quillcast.operators import augment, boosting, clean, ensemble, models, resolve, rolling, schedule, split_scale
from quillcast.plans import forecast, queries_clean
from quillcast.sources import odds, pages, sinks, tables
from quillcast.streaming.ingest import ingest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("Luka Dončić", "Luka Doncic"), ("Đorđe", "ore"), ("Egor Dёmin", "Egor Dmin"), ("", ""), (None, None)])
def test_strip_accents(spark, raw, want):
    assert one(spark, ft.strip_accents(F.col("v")), raw) == want


@pytest.mark.parametrize("raw,want", [('"Jayson Tatum"', "Jayson Tatum"), ('"LeBron James" (LAL)', 'LeBron James"'), ("Some Player TWO-WAY", "Some Player"), ("Stephen  Curry  OUT", "Stephen Curry"), ("Kevin Durant (PHX - SF) DTD", "Kevin Durant"), ("'A B'", "A B"), (None, None), ("", "")])
def test_clean_entity_name(spark, raw, want):
    assert one(spark, ft.clean_entity_name(F.col("v")), raw) == want


@pytest.mark.parametrize("raw,want", [("25.3 12", "25.3"), ("  x ", "x"), ("", None), (None, None)])
def test_first_token(spark, raw, want):
    assert one(spark, ft.first_token(F.col("v")), raw) == want


@pytest.mark.parametrize("raw,want", [("10.5", 10.5), ("abc", 0.0), (None, 0.0), ("", 0.0), ("1d", 0.0), (" 7 ", 7.0), ("-3e2", -300.0)])
def test_safe_float(spark, raw, want):
    assert one(spark, fv.safe_float(F.col("v")), raw) == want


@pytest.mark.parametrize("raw,want", [("Thu, Apr 9, 2026", "2026-04-09"), ("Nov 28, 2025", "2025-11-28"), ("2026-04-09", "2026-04-09"), ("20260409", "2026-04-09"), ("soon", None), (None, None)])
def test_parse_date(spark, raw, want):
    got = one(spark, fv.parse_date(F.col("v")), raw)
    assert (str(got) if got else None) == want


def test_truthy_returns_the_last_operand_as_it_is(spark):
    df = spark.createDataFrame([(0, None, 5), (0, 0, 0), (None, 3, 1)], "a int, b int, c int")
    assert [r.x for r in df.select(fv.truthy(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == [5, 0, 3]


def test_signed_text_and_split_name(spark):
    assert [one(spark, ft.signed_text(F.col("v")), v, "double") for v in (3.5, -2.0, 0.0)] == ["+3.5", "-2.0", "0.0"]
    first, last = ft.split_name(F.col("v"))
    assert (one(spark, first, "Nene"), one(spark, last, "Nene")) == ("", "Nene")


REF = [("p1", "Luka Dončić", 10.0, 1), ("p2", "Gary Trent Jr.", 11.0, 2), ("p3", "Tim Hardaway Jr.", 12.0, 3), ("p4", "LeBron James", 13.0, 4), (None, None, None, 5)]


@pytest.mark.parametrize("name,tier,match", [("luka doncic", 1, "p1"), ("LEB", 2, "p4"), ("Tim Hardaway Jr.", 1, "p3"), ("Jaren Jackson Jr.", 3, "p2"), ("Jr", 2, "p2"), ("x.", None, None), ("nobody", None, None), ("", None, None), (None, None, None), ("J..", None, None)])
def test_resolve_tiers(spark, name, tier, match):
    ref = spark.createDataFrame(REF, "id string, name string, usage double, o int")
    q = spark.createDataFrame([(1, name)], "k int, q string")
    r = resolve.resolve(q, ref, "q", "name", "o").first()
    assert (r["tier"], r["match"]["id"] if r["match"] else None) == (tier, match)


def test_resolve_value_defaults(spark):
    ref = spark.createDataFrame(REF, "id string, name string, usage double, o int")
    q = spark.createDataFrame([("nobody",), ("luka doncic",)], "q string")
    assert sorted(r.usage for r in resolve.resolve_value(q, ref, "q", "name", "usage", "o").collect()) == [10.0, 20.0]
    assert {r.usage for r in resolve.resolve_value(q, ref.limit(0), "q", "name", "usage", "o").collect()} == {25.0}


def test_exact_beats_containment(spark):
    ref = spark.createDataFrame([("PG", "SAC", 20.0, 1), ("PG", "SA", 30.0, 2)], "position string, team string, pts double, o int")
    asked = spark.createDataFrame([("PG", "SAS", "SA"), ("PG", "XX", "YY")], "position string, key string, alias string")
    got = {r.key: r.pts for r in resolve.prefer_exact(asked, ref, "position", "key", "alias", "team", {"pts": 45.0}, "o").collect()}
    assert got == {"SAS": 30.0, "XX": 45.0}


def test_lookup_chain_last_duplicate_wins(spark):
    first = spark.createDataFrame([("a", "PG", 1), ("a", "C", 2)], "n string, p string, o int")
    second = spark.createDataFrame([("b", "SF", 1)], "n string, p string, o int")
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "n0 string")
    got = resolve.lookup_chain(q, "n0", [(first, "n", "p", "o", True), (second, "n", "p", "o", False)], "SG", "position")
    assert {r.n0: r.position for r in got.collect()} == {"a": "C", "b": "SF", "c": "SG"}


def test_schedule_expand_and_slate(spark):
    g = spark.createDataFrame([(1, 10, 20, "Thu, Apr 9, 2026"), (2, 30, 30, "Apr 9, 2026"), (3, None, 5, "bad")], "id int, h int, v int, d string")
    rows = {(r.id, r.team, r.opponent, r.is_home) for r in schedule.expand(g, "h", "v").collect()}
    assert rows == {(1, 10, 20, 1), (1, 20, 10, 0), (2, 30, 30, 1), (3, 5, None, 0)}
    assert {r.id for r in schedule.slate(g, "d", "2026-04-09").collect()} == {1, 2}


def test_rolling_and_latest(spark):
    log = spark.createDataFrame([("a", d, float(d) if d != 3 else None) for d in range(1, 8)], "e string, d int, PTS double")
    last = rolling.latest_means(log, "e", ["d"], ["PTS", "NONE"]).first()
    assert last["PTS_roll_avg"] == pytest.approx(np.mean([4, 5, 6, 7])) and last["n_rows"] == 5
    assert rolling.rolling_means(log, "e", ["d"], ["PTS"], 1).filter("d = 7").first()["PTS_roll_avg"] == 7
    assert rolling.rolling_means(log, "e", ["d"], ["NONE"]).columns == ["e", "d", "PTS"]


def test_first_and_last_of_shuffled_rows(spark):
    df = spark.createDataFrame([("a", k, f"v{k}") for k in range(20)], "k string, o int, v string").repartition(5)
    assert clean.keep_first(df, ["k"], "o").first()["v"] == "v0" and clean.keep_last(df, ["k"], "o").first()["v"] == "v19"


def test_null_first_duplicate_removes_the_entity(spark):
    raw = spark.createDataFrame([("A", "X", None, 1), ("A", "Y", "20.1", 2), ("B", "Z", "18", 3), ("Player", "Team", "USG", 4)], "Player string, Team string, u string, o int")
    assert [(r.Player, r.u) for r in queries_clean.usage_table(raw, "Player", "Team", "u", "o").collect()] == [("B", 18.0)]


def test_split_valid(spark):
    df = spark.createDataFrame([("a", 0.0), (" ", 1.0), ("b", None)], "n string, s double")
    assert [r.reason for r in clean.split_valid(df, ["n"], ["s"]).collect()] == [None, "no n", "no s"]


def test_odds_shapes(spark):
    raw = ['[{"home_team":"A","away_team":"B","markets":{"spreads":[{"home_handicap":-3.5}],"totals":{"total":220}}},{"home_team":"","away_team":"B"},{}]',
           '{"data":[],"matches":[{"home_team":"C","away_team":"D"}]}', '{"events":[{"home_team":"E","away_team":"F","markets":{"spreads":{"home_handicap":0,"home_odds":-110}}}]}', "[]", "", None, "{broken"]
    df = spark.createDataFrame([(r,) for r in raw], "value string")
    got = {r.home_team: r for r in odds.flatten(odds.matches(df)).collect()}
    assert set(got) == {"A", "E"} and (got["A"].home_spread, got["A"].total_line, got["E"].home_spread, got["E"].home_spread_odds) == (-3.5, 220.0, None, -110.0)
    assert odds.flatten(odds.matches(df), zero_is_value=True).filter("home_team = 'E'").first().home_spread == 0.0


def test_html_tables(spark):
    html = '<table id=t><tr class="thead"><th>H</th></tr><tr><th> a <b>x</b></th><td>1</td></tr><tr><td>only</td></tr></table>'
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    assert [(r.page_id, r.table_id, r.row_ix, r.cells) for r in pages.table_rows(df, 2).collect()] == [(1, "t", 1, ["a", "1"])]


def test_sinks_and_freshness(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.write_dual(df, str(tmp_path / "x"))
    assert spark.read.schema("k int, v string").json(str(tmp_path / "x.json")).count() == tables.csv(spark, str(tmp_path / "x.csv"), "k int, v string").count() == 2
    assert sinks.write_unless_empty(df.limit(0), str(tmp_path / "e")) is None and not (tmp_path / "e").exists()
    sinks.write_by(df, "v", str(tmp_path / "by"))
    assert tables.partition_of(spark.read.parquet(str(tmp_path / "by")), "v", "a").count() == 1
    assert tables.first_available(spark, [("json", str(tmp_path / "no")), ("csv", str(tmp_path / "x.csv"))], "k int, v string").count() == 2
    assert tables.first_two_columns(spark, str(tmp_path / "missing"), ("a", "b")).count() == 0
    calls = []

    def build():
        calls.append(1)
        return df

    path = str(tmp_path / "cache")
    assert tables.materialize(spark, build, path).count() == 2 and tables.materialize(spark, build, path).count() == 2 and len(calls) == 1
    assert tables.materialize(spark, lambda: df.limit(0), path, force=True).count() == 2
    assert tables.materialize(spark, lambda: 1 / 0, path, hours=0).count() == 2
    assert not tables.with_freshness(spark.read.parquet(path)).first()["is_stale"]


def test_stream_ingest(spark, tmp_path):
    spark.createDataFrame([(1, "Player"), (2, "x")], "k int, v string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v string").json(str(tmp_path / "in"))
    ingest(stream, lambda b: clean.drop_header_rows(b, "v", "Player"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def row(spark):
    base = {c: augment.DEFAULTS.get(c, 1.0) for c in augment.FEATURES} | {"usage_rate": 27.5, "is_home": 1.0, "total": 225.0, "opp_pts_allowed": 25.0, "opp_reb_allowed": 8.0, "opp_ast_allowed": 6.0}
    return spark.createDataFrame([{"e": k, **base, "pts": 20.0 + k} for k in range(12)])


def test_augmentation(spark):
    a = forecast.training_rows(row(spark), "e", 100)
    b = forecast.training_rows(row(spark).repartition(7), "e", 100)
    assert a.count() == 1200 and a.exceptAll(b.select(a.columns)).count() == 0
    r = a.agg(F.min("target_pts"), F.min("target_fd"), F.countDistinct("usage_rate"), F.min("reb"), F.max("reb")).first()
    assert r[0] >= 0 and r[1] >= 0 and r[2] == 1 and 6.4 <= r[3] < r[4] <= 9.6


def test_split_is_exact(spark):
    df = spark.range(50).selectExpr("id", "id % 3 g")
    got = {r.g: (r.t, r.n) for r in split_scale.exact_split(df, "g", ["id"]).groupBy("g").agg(F.sum(F.col("is_test").cast("int")).alias("t"), F.count("*").alias("n")).collect()}
    assert all(t == -(-n // 5) for t, n in got.values())


def test_confidence_bounds(spark):
    p = spark.createDataFrame([(1, "a", 10.0), (1, "b", 12.0), (2, "a", -1.0), (2, "b", 5.0)], "r int, model string, prediction double")
    s = spark.createDataFrame([("a", 0.9)], "model string, score double")
    got = {r.r: r for r in ensemble.combine(p, "r", s).collect()}
    assert got[1].prediction == 11 and got[1].mean_score == pytest.approx(0.85) and all(60 <= x.confidence <= 99 for x in got.values())


@pytest.mark.parametrize("name", ["linear", "bayesian", "hist_level", "hist_leaf"])
def test_models_fit(spark, name):
    df = spark.range(400).selectExpr("id", "cast(id % 20 as double) a", "cast(id % 7 as double) b").selectExpr("*", "3 * a - 2 * b + 1 y").coalesce(2)
    fit = models.ESTIMATORS[name] if "hist" not in name else boosting.fit_histogram(name[5:], trees=12, depth=4)
    out = fit(df, ["a", "b"], "y")(df).agg(ensemble.r2("y", "prediction").alias("r2")).first()["r2"]
    assert out > (0.999 if "hist" not in name else 0.8)


def test_leaf_wise_trees_have_all_their_leaves(spark):
    """One tree against the definition: split the leaf of most gain, one at a time, up to 31 leaves and depth 6."""
    raw = [(float(k % 37), float(k * 7 % 41), float((k % 37 * 97 + k * 7 % 41 * 31) % 101)) for k in range(12000)]
    df = spark.createDataFrame(raw, "a double, b double, y double").coalesce(3)
    edges = boosting.bin_edges(df, ["a", "b"])
    x = np.column_stack([np.searchsorted(e, [r[k] for r in raw], "left") for k, e in enumerate(edges)])
    g = -(np.array([r[2] for r in raw]) - np.mean([r[2] for r in raw]))

    def split(rows, depth):
        sums = np.zeros((2, max(map(len, edges)) + 1, 2))
        for f in range(2):
            np.add.at(sums[f, :, 0], x[rows, f], g[rows])
            np.add.at(sums[f, :, 1], x[rows, f], 1)
        return (*(boosting.best_split(sums, 1.0, 20) if depth < 6 else (0.0, -1, -1)), rows, depth)

    found = [split(np.arange(12000), 0)]
    while len(found) < 31 and max(f[0] for f in found) > 1e-12:
        _, f, b, rows, depth = found.pop(int(np.argmax([f[0] for f in found])))
        low = x[rows, f] <= b
        found += [split(rows[low], depth + 1), split(rows[~low], depth + 1)]
    want = np.zeros(12000)
    for *_, rows, _ in found:
        want[rows] = -g[rows].sum() / (len(rows) + 1.0)
    got = boosting.fit_histogram("leaf", trees=1, rate=1.0)(df, ["a", "b"], "y")(df).collect()
    mean = np.mean([r[2] for r in raw])
    assert len(found) == 31 and len({round(r["prediction"], 6) for r in got}) == 31
    assert {(r["a"], r["b"]): r["prediction"] for r in got} == pytest.approx({(r[0], r[1]): w + mean for r, w in zip(raw, want)})


def test_failed_model_is_left_out(spark, monkeypatch):
    monkeypatch.setitem(models.ESTIMATORS, "gbt", lambda *a: 1 / 0)
    df = spark.range(50).selectExpr("cast(id as double) a", "cast(id as double) y")
    scorers, status = models.fit_all(df, ["a"], "y", ["linear", "gbt"])
    assert set(scorers) == {"linear"} and status["gbt"].startswith("ZeroDivisionError")
    with pytest.raises(ValueError):
        models.score_long(df, {}, "a")


def test_predict_keeps_rows_without_score(spark):
    f = row(spark)
    requests = f.selectExpr("e", "e <> 1 found", "e <> 2 averages", "e <> 3 game")
    got = {r.e: r for r in forecast.predict(requests, f, "e", "POINTS", 20, names=["linear", "bayesian"]).collect()}
    assert (got[1].status, got[2].status, got[3].status) == ("not_found", "no_averages", "no_game") and got[1].prediction is None
    assert got[5].n_models == 2 and 60 <= got[5].confidence <= 99
    with pytest.raises(ValueError):
        forecast.target_column("goals")
