"""Queries for metrics, scaling, feature assembly, augmentation, training and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.operators import augment, ensemble, models, split_scale
from quillcast.operators.augment import DEFAULTS, FEATURES, NUMERIC
from quillcast.plans import forecast
from quillcast.plans.catalog import Tables, query

#: Predictions of three stand-in models for each order, from its line items.
STAND_IN_SQL = """p AS (SELECT l_orderkey AS request_id, 'a' AS model, l_quantity AS y, l_quantity + l_linenumber AS prediction, 0.9 AS score FROM lineitem
  UNION ALL SELECT l_orderkey, 'b', l_quantity, l_quantity * 1.5 - 4, 0.5 FROM lineitem UNION ALL SELECT l_orderkey, 'c', l_quantity, 26 - l_linenumber, NULL FROM lineitem)"""


def stand_in(t: Tables) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    each = F.array(*(F.struct(F.lit(m).alias("model"), p.cast("double").alias("prediction")) for m, p in (("a", q + n), ("b", q * 1.5 - 4), ("c", 26 - n))))
    return t.lineitem.select(F.col("l_orderkey").alias("request_id"), q.alias("y"), F.explode(each).alias("x")).select("request_id", "y", "x.*")


def stand_in_scores(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("a", 0.9), ("b", 0.5)], "model string, score double")


@query("ensemble_mean", f"WITH {STAND_IN_SQL} SELECT request_id, round(avg(prediction), 6) AS prediction FROM p GROUP BY request_id")
def ensemble_mean(t: Tables) -> DataFrame:
    return ensemble.combine(stand_in(t), "request_id").select("request_id", F.round("prediction", 6).alias("prediction"))


@query("ensemble_std", f"WITH {STAND_IN_SQL} SELECT request_id, round(stddev_pop(prediction), 6) AS spread FROM p GROUP BY request_id")
def ensemble_std(t: Tables) -> DataFrame:
    return ensemble.combine(stand_in(t), "request_id").select("request_id", F.round("spread", 6).alias("spread"))


@query("avg_score", f"WITH {STAND_IN_SQL} SELECT request_id, round(avg(coalesce(score, 0.8)), 6) AS mean_score, count(*) AS n_models FROM p GROUP BY request_id")
def avg_score(t: Tables) -> DataFrame:
    return ensemble.combine(stand_in(t), "request_id", stand_in_scores(t)).select("request_id", F.round("mean_score", 6).alias("mean_score"), "n_models")


@query("ensemble_confidence", f"""WITH {STAND_IN_SQL}, e AS (SELECT request_id, avg(prediction) AS m, stddev_pop(prediction) AS s, avg(coalesce(score, 0.8)) AS r FROM p GROUP BY request_id)
  SELECT request_id, round(least(99, greatest(60, (0.7 * r + 0.3 * CASE WHEN m > 0 THEN 1 - least(s / m, 0.3) ELSE 0.85 END) * 100)), 4) AS confidence FROM e""")
def ensemble_confidence(t: Tables) -> DataFrame:
    return ensemble.combine(stand_in(t), "request_id", stand_in_scores(t)).select("request_id", F.round("confidence", 4).alias("confidence"))


@query("metric_mae", f"WITH {STAND_IN_SQL} SELECT model, round(avg(abs(y - prediction)), 6) AS mae FROM p GROUP BY model")
def metric_mae(t: Tables) -> DataFrame:
    return stand_in(t).groupBy("model").agg(F.round(ensemble.mae("y", "prediction"), 6).alias("mae"))


@query("metric_r2", f"""WITH {STAND_IN_SQL}, m AS (SELECT model, avg(y) AS a FROM p GROUP BY model) SELECT p.model, round(1 - sum((y - prediction) ** 2) / sum((y - a) ** 2), 6) AS r2 FROM p JOIN m ON m.model = p.model GROUP BY p.model""")
def metric_r2(t: Tables) -> DataFrame:
    return stand_in(t).groupBy("model").agg(F.round(ensemble.r2("y", "prediction"), 6).alias("r2"))


@query("standard_scale", """SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER w) / CASE WHEN stddev_pop(p_retailprice) OVER w = 0 THEN 1 ELSE stddev_pop(p_retailprice) OVER w END, 6) AS p_retailprice_z,
  round((p_size - avg(p_size) OVER w) / stddev_pop(p_size) OVER w, 6) AS p_size_z FROM part WINDOW w AS (PARTITION BY p_type)""")
def standard_scale(t: Tables) -> DataFrame:
    out = split_scale.standardize(t.part.select("p_partkey", "p_type", "p_retailprice", "p_size"), ["p_retailprice", "p_size"], ["p_type"])
    return out.select("p_partkey", F.round("p_retailprice_z", 6).alias("p_retailprice_z"), F.round("p_size_z", 6).alias("p_size_z"))


def game_log(t: Tables) -> DataFrame:
    """A log row for each order, its statistics from the line items."""
    part = lambda c, v: F.sum(F.when(F.col(c) == v, 1.0).otherwise(0.0))
    stats = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("pts"), F.count("*").cast("double").alias("reb"), F.sum(F.round(F.col("l_discount") * 100)).alias("ast"), F.max("l_quantity").alias("mins"), F.sum(F.round(F.col("l_tax") * 100)).alias("fga"),
        F.min("l_quantity").alias("fg3a"), part("l_returnflag", "R").alias("fta"), part("l_returnflag", "A").alias("stl"), part("l_linestatus", "F").alias("blk"), part("l_linestatus", "O").alias("tov"),
    )
    return stats.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate", *NUMERIC)


def entities(t: Tables) -> DataFrame:
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return t.customer.select(k, F.pmod(F.floor(b / 400), F.lit(30)).cast("double").alias("usage_rate"), (F.col("c_nationkey") % 2).alias("is_home"), (k % 21 - 10).cast("double").alias("spread"), (200 + k % 50).cast("double").alias("total"), F.col("c_nationkey").alias("opponent"))


def opponents(t: Tables) -> DataFrame:
    per = t.supplier.filter(F.col("s_nationkey") % 4 != 0).groupBy(F.col("s_nationkey").alias("opponent"))
    return per.agg(F.round(F.avg("s_acctbal") / 200, 6).alias("opp_pts_allowed"), F.count("*").cast("double").alias("opp_reb_allowed"), (F.max("s_suppkey") % 9).cast("double").alias("opp_ast_allowed"), F.lit(None).cast("double").alias("opp_fd_allowed"))


FEATURES_SQL = """l AS (SELECT l_orderkey, sum(l_quantity) AS pts, CAST(count(*) AS DOUBLE) AS reb, sum(round(l_discount * 100)) AS ast, max(l_quantity) AS mins, sum(round(l_tax * 100)) AS fga, min(l_quantity) AS fg3a,
  CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS fta, CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS stl, CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS blk, CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) AS tov FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_custkey AS c_custkey, avg(pts) AS pts, avg(reb) AS reb, avg(ast) AS ast, avg(mins) AS mins, avg(fga) AS fga, avg(fg3a) AS fg3a, avg(fta) AS fta, avg(stl) AS stl, avg(blk) AS blk, avg(tov) AS tov
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM l JOIN orders ON l_orderkey = o_orderkey) WHERE n <= 5 GROUP BY o_custkey),
o AS (SELECT s_nationkey AS opponent, round(avg(s_acctbal) / 200, 6) AS opp_pts_allowed, CAST(count(*) AS DOUBLE) AS opp_reb_allowed, CAST(max(s_suppkey) % 9 AS DOUBLE) AS opp_ast_allowed FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY s_nationkey),
f AS (SELECT c.c_custkey, {numeric},
  CAST(((floor(c_acctbal / 400) % 30) + 30) % 30 AS DOUBLE) AS usage_rate, CAST(c_nationkey % 2 AS DOUBLE) AS is_home, CAST(c.c_custkey % 21 - 10 AS DOUBLE) AS spread, CAST(200 + c.c_custkey % 50 AS DOUBLE) AS total,
  coalesce(opp_pts_allowed, 25.0) AS opp_pts_allowed, coalesce(opp_reb_allowed, 8.0) AS opp_reb_allowed, coalesce(opp_ast_allowed, 6.0) AS opp_ast_allowed, 45.0::DOUBLE AS opp_fd_allowed
  FROM customer c LEFT JOIN r ON r.c_custkey = c.c_custkey LEFT JOIN o ON o.opponent = c_nationkey)"""
PLAIN_SQL = FEATURES_SQL.format(numeric=", ".join(f"coalesce({c}, 0.0) AS {c}" for c in NUMERIC))
FILLED_SQL = FEATURES_SQL.format(numeric=", ".join(f"coalesce({c}, {DEFAULTS[c]}) AS {c}" for c in NUMERIC))
ROUNDED_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES)


def features(t: Tables, defaults: dict[str, float] | None = None) -> DataFrame:
    return forecast.feature_row(entities(t), game_log(t), opponents(t), "c_custkey", ["o_orderdate", "o_orderkey"], "opponent", defaults)


@query("feature_vector", f"WITH {PLAIN_SQL} SELECT c_custkey, {ROUNDED_SQL} FROM f")
def feature_vector(t: Tables) -> DataFrame:
    return features(t).select("c_custkey", *(F.round(c, 6).alias(c) for c in FEATURES))


@query("feature_defaults", f"WITH {FILLED_SQL} SELECT c_custkey, {ROUNDED_SQL} FROM f")
def feature_defaults(t: Tables) -> DataFrame:
    return features(t, DEFAULTS).select("c_custkey", *(F.round(c, 6).alias(c) for c in FEATURES))


def noise_sql(name: str, low: float, high: float, keys: str) -> str:
    width = repr(high - low)
    return f"({low} + {width} * (('0x' || substr(md5('42:{name}:' || {keys}), 1, 8))::BIGINT / 4294967296.0))"


#: Of augment_noise, whose SQL has this number; the queries that train models take the default of 100.
COPIES = 10
COPY_KEY = "c_custkey || ':' || copy"


@query("augment_noise", f"WITH {PLAIN_SQL}, c AS (SELECT *, unnest(range(0, {COPIES})) AS copy FROM f) SELECT c_custkey, CAST(copy AS INT) AS copy, round(pts * {noise_sql('pts', 0.8, 1.2, COPY_KEY)}, 6) AS pts, round(total * {noise_sql('total', 0.8, 1.2, COPY_KEY)}, 6) AS total, usage_rate, is_home FROM c")
def augment_noise(t: Tables) -> DataFrame:
    out = augment.replicate(features(t).select("c_custkey", "pts", "total", "usage_rate", "is_home"), ["c_custkey"], ["pts", "total"], COPIES)
    return out.select("c_custkey", "copy", F.round("pts", 6).alias("pts"), F.round("total", 6).alias("total"), "usage_rate", "is_home")


def _n(name: str, bounds: tuple[float, float]) -> str:
    return noise_sql(name, *bounds, "c_custkey")


HOME_SQL = "CASE WHEN is_home = 1 THEN 1.05 ELSE 0.98 END"


@query("augment_targets", f"""WITH {PLAIN_SQL}, x AS (SELECT *, pts * {_n('t_pts', (0.9, 1.1))} * (usage_rate / 25) * (opp_pts_allowed / 25) * {HOME_SQL} * (total / 220) * {_n('f_pts', (0.95, 1.05))} AS tp,
  reb * {_n('t_reb', (0.9, 1.1))} * (opp_reb_allowed / 8) * {HOME_SQL} * {_n('f_reb', (0.95, 1.05))} AS tr, ast * {_n('t_ast', (0.9, 1.1))} * (usage_rate / 25) * (opp_ast_allowed / 6) * {HOME_SQL} * {_n('f_ast', (0.95, 1.05))} AS ta FROM f)
  SELECT c_custkey, round(greatest(tp, 0), 5) AS target_pts, round(greatest(tr, 0), 5) AS target_reb, round(greatest(ta, 0), 5) AS target_ast, round(greatest(tp + 1.2 * tr + 1.5 * ta + 3 * stl + 3 * blk - tov, 0), 5) AS target_fd FROM x""")
def augment_targets(t: Tables) -> DataFrame:
    out = augment.targets(features(t), ["c_custkey"])
    return out.select("c_custkey", *(F.round(c, 5).alias(c) for c in ("target_pts", "target_reb", "target_ast", "target_fd")))


@query("weighted_score", """SELECT l_orderkey, round(sum(greatest(l_quantity + 1.2 * l_linenumber + 1.5 * l_discount + 3 * l_tax + 3 * l_tax - l_extendedprice / 1000, 0)), 5) AS score FROM lineitem GROUP BY l_orderkey""")
def weighted_score(t: Tables) -> DataFrame:
    score = augment.weighted_score(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_discount"), F.col("l_tax"), F.col("l_tax"), F.col("l_extendedprice") / 1000)
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(score), 5).alias("score"))


@query("linear_one_feature", "SELECT p_type, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type")
def linear_one_feature(t: Tables) -> DataFrame:
    rows = t.part.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_type").agg(F.round(F.regr_slope("p_retailprice", "p_size"), 6).alias("slope"), F.round(F.regr_intercept("p_retailprice", "p_size"), 4).alias("intercept"))


@query("projected_value", f"""WITH {PLAIN_SQL} SELECT c_custkey, c_name, n_name, r_name, round(pts, 6) AS recent_pts, round(pts * (usage_rate / 25) * (opp_pts_allowed / 25) * {HOME_SQL} * (total / 220), 5) AS projected
  FROM f JOIN customer USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def projected_value(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    named = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")
    home = F.when(F.col("is_home") == 1, augment.HOME).otherwise(augment.AWAY)
    value = F.col("pts") * (F.col("usage_rate") / 25) * (F.col("opp_pts_allowed") / 25) * home * (F.col("total") / 220)
    return features(t).join(named, "c_custkey").select("c_custkey", "c_name", "n_name", "r_name", F.round("pts", 6).alias("recent_pts"), F.round(value, 5).alias("projected"))


def _fit_query(name: str) -> None:
    @query(f"fit_{name}")
    def fit(t: Tables) -> DataFrame:
        _, report = forecast.fit(features(t), "c_custkey", "points", names=[name])
        return report


for _name in models.MODELS:
    _fit_query(_name)


@query("model_report")
def model_report(t: Tables) -> DataFrame:
    _, report = forecast.fit(features(t), "c_custkey", "Rebounds")
    return report


@query("score_long")
def score_long(t: Tables) -> DataFrame:
    f = features(t)
    scorers, _ = forecast.fit(f, "c_custkey", "assists")
    return models.score_long(f, scorers, "c_custkey")


def requests(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k, (k % 17 != 0).alias("found"), (k % 19 != 0).alias("averages"), (k % 23 != 0).alias("game"))


@query("predict_batch")
def predict_batch(t: Tables) -> DataFrame:
    return forecast.predict(requests(t), features(t), "c_custkey", "points")


@query("request_status", "SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN 'not_found' WHEN c_custkey % 19 = 0 THEN 'no_averages' WHEN c_custkey % 23 = 0 THEN 'no_game' ELSE 'ok' END AS status FROM customer")
def request_status(t: Tables) -> DataFrame:
    return requests(t).select("c_custkey", forecast.status_of("found", "averages", "game").alias("status"))


@query("result_shape", f"WITH {PLAIN_SQL} SELECT c_custkey, round(pts, 6) AS prediction, CAST(is_home AS INT) AS is_home FROM f")
def result_shape(t: Tables) -> DataFrame:
    return features(t).select("c_custkey", F.round("pts", 6).alias("prediction"), F.col("is_home").cast("int").alias("is_home"))
