"""From raw tables to forecasts: the log, the feature row of each entity, training rows, and predictions with a status."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcast.functions import text as ft
from quillcast.functions.values import safe_float
from quillcast.operators import augment, boosting, ensemble, entity_models, models, resolve, rolling, schedule, split_scale
from quillcast.operators.augment import CONTEXT, FEATURES, NUMERIC

#: The target of each statistic, and defaults of what the opponents allow.
TARGETS = {"points": "target_pts", "rebounds": "target_reb", "assists": "target_ast", "fantasy": "target_fd"}
ALLOWED = {"opp_pts_allowed": 25.0, "opp_reb_allowed": 8.0, "opp_ast_allowed": 6.0, "opp_fd_allowed": 45.0}


def feature_row(entities: DataFrame, log: DataFrame, opponents: DataFrame, entity: str, order: list[str], opponent: str, defaults: dict[str, float] | None = None) -> DataFrame:
    """The 18 feature columns for each entity that has usage_rate, is_home, spread, total and `opponent`.

    Recent means come from its last five log rows; missing ones are 0, or their default. What the opponent
    allows comes from opponents (one row for each), else from ALLOWED."""
    recent = rolling.latest_means(log, entity, order, NUMERIC, 5, "").drop("n_rows")
    out = entities.join(recent, entity, "left").join(opponents, opponent, "left")
    fill = defaults or {}
    numeric = [F.coalesce(F.col(c), F.lit(fill.get(c, 0.0))).alias(c) for c in NUMERIC]
    context = [F.coalesce(F.col(c).cast("double"), F.lit(ALLOWED.get(c, 0.0))).alias(c) for c in CONTEXT]
    return out.select(entity, *numeric, *context)


def training_rows(features: DataFrame, entity: str, copies: int = 100, seed: int = 42, noise: str = "counter") -> DataFrame:
    """`copies` noisy replicas of each feature row, with targets. is_home and usage_rate stay as they are."""
    noisy = [c for c in FEATURES if c not in ("is_home", "usage_rate")]
    return augment.targets(augment.replicate(features, [entity], noisy, copies, seed, noise), [entity, "copy"], seed, noise)


def status_of(found: str, averages: str, game: str) -> Column:
    """not_found, no_averages, no_game or ok, from three flags."""
    return F.when(~F.col(found), "not_found").when(~F.col(averages), "no_averages").when(~F.col(game), "no_game").otherwise("ok")


def target_column(name: str) -> str:
    """The target column of a statistic's name, in any case."""
    try:
        return TARGETS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown statistic: {name}") from None


def settled(df: DataFrame) -> DataFrame:
    """df computed once, under a plan of one step: training is many jobs side by side, each of which leaves its whole plan as text with the driver, that of a persisted table included.

    Kept in the checkpoint folder, where there is one; else with the executors, as persisted tables are, but not made again if one is lost."""
    df = df.persist()
    out = df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()
    df.unpersist()
    return out


def fit(features: DataFrame, entity: str, target: str = "points", copies: int = 100, seed: int = 42, names: list[str] | None = None):
    """(scorers, report): all models on 80 % of the training rows; report has model, status, mae, r2 on the rest.

    A model that fails is left out and its error is its status. The features are held while the models are fitted and measured; the training rows,
    `copies` times as many, are made again by each pass, which costs less than to store and read them. The report has one row for each model."""
    label = target_column(target)
    features = settled(features.select(entity, *FEATURES))
    rows = split_scale.pooled_split(training_rows(features, entity, copies, seed).select(entity, "copy", *FEATURES, label), [entity, "copy"], 0.2, seed)
    scorers, status = models.fit_all(rows.filter("NOT is_test"), FEATURES, label, names)
    errors = {}
    if scorers:
        test = rows.filter("is_test").select(entity, "copy", label, *FEATURES)
        scored = models.score_long(test, scorers, entity, "copy", label)
        found = scored.groupBy("model").agg(ensemble.mae(label, "prediction").alias("mae"), ensemble.r2(label, "prediction").alias("r2"))
        errors = {r["model"]: (r["mae"], r["r2"]) for r in found.collect()}
    report = [(m, s, *errors.get(m, (None, None))) for m, s in status.items()]
    return scorers, features.sparkSession.createDataFrame(report, "model string, status string, mae double, r2 double")


def predict(requests: DataFrame, features: DataFrame, entity: str, target: str = "points", copies: int = 100, seed: int = 42, names: list[str] | None = None) -> DataFrame:
    """requests(entity, found, averages, game) with status, prediction, spread, mean_score, confidence, n_models.

    Rows that can't be scored keep their status and have nulls. The features are held (in memory or on disk) from training
    to scoring, so they are assembled once."""
    features = settled(features)
    scorers, report = fit(features, entity, target, copies, seed, names)
    able = requests.withColumn("status", status_of("found", "averages", "game"))
    ready = able.filter("status = 'ok'").select(entity).join(features, entity)
    scores = report.select("model", F.col("r2").alias("score"))
    out = ensemble.combine(models.score_long(ready, scorers, entity), entity, scores)
    return able.select(entity, "status").join(out, entity, "left")


#: The defence table's abbreviations of teams, where they differ.
TEAM_ALIASES = {"GSW": "GS", "NOP": "NO", "NYK": "NY", "PHX": "PHO", "SAS": "SA", "BRK": "BKN", "CHO": "CHA"}
#: Which recent average is which numeric feature.
RECENT_OF = {"pts": "pts", "reb": "reb", "ast": "ast", "mins": "min", "fga": "fga", "fg3a": "fg3a", "fta": "fta", "stl": "stl", "blk": "blk", "tov": "tov"}


@dataclass
class Sources:
    """The tables of a prediction. Each has `o`, which orders its rows: where several match, the first one counts.

    info: player_id, player_name, team_id, position. averages: Player and the columns of resolve.RECENT. usage: PLAYER, USGPCT.
    games: home, visitor (team ids). teams: id, abbreviation (one row each, no order). positions: name, position (the last
    one counts). defense: position, Team, PTS, REB, AST."""

    info: DataFrame
    averages: DataFrame
    usage: DataFrame
    games: DataFrame
    teams: DataFrame
    positions: DataFrame
    defense: DataFrame


def request_features(requests: DataFrame, s: Sources, aliases: dict[str, str] | None = None) -> DataFrame:
    """requests(request_id, name, spread, total) with player_id, position, opponent, status and the 18 features.

    Names are resolved against info, averages and usage, the team's first game gives opponent and is_home, the position
    and the opponent give what the defence allows. status is not_found, no_averages, no_game or ok, from what these joins
    found. A missing average is 0, usage and defence have their defaults; without a game is_home is null."""
    q = requests.select("request_id", "name", F.col("spread").cast("double").alias("spread"), F.col("total").cast("double").alias("total"))
    # Every lookup starts from the different names, so that the plan grows with the number of lookups and not with its power.
    names = q.select("name").filter("name IS NOT NULL").distinct()
    info = s.info.select("player_id", "player_name", "team_id", "position", "o")
    found = resolve.resolve_in(resolve.own_positions(names, "name", s.positions), "name", {
        "who": resolve.Reference(info, "player_name", "o"), "averages": resolve.Reference(resolve.recent_rows(s.averages, "Player", "o"), "_player", "o"),
        "usage": resolve.Reference(s.usage.select("PLAYER", "USGPCT", "o"), "PLAYER", "o"), "place": resolve.Reference(info, "player_name", "o", (1, 3)),
    })
    found = found.select(
        "name", F.col("who").isNotNull().alias("found"), F.col("who.match.player_id").alias("player_id"), F.nullif(F.col("who.match.team_id").cast("long"), F.lit(0).cast("long")).alias("team_id"),
        F.col("averages").isNotNull().alias("has_averages"), *(F.col(f"averages.match.{c}").alias(c) for c in resolve.RECENT),
        resolve.value_of("usage.match", "USGPCT", s.usage).alias("usage_rate"), resolve.position_of(F.col("_own"), "place.match").alias("position"),
    )
    teams = s.info.select(F.col("team_id").cast("long").alias("team_id")).distinct()
    game = schedule.game_context(teams, "team_id", s.games, "home", "visitor", s.teams, "id", "abbreviation", "o")
    found = q.join(found, "name", "left")
    found = found.join(game, "team_id", "left").withColumns({"found": F.coalesce("found", F.lit(False)), "has_averages": F.coalesce("has_averages", F.lit(False)), "position": F.coalesce("position", F.lit("SG"))})
    found = found.withColumn("_alias", F.coalesce(ft.alias(F.col("opponent"), aliases or TEAM_ALIASES), F.lit(""))).withColumn("_key", F.coalesce("opponent", F.lit("")))
    number = lambda c: safe_float(ft.first_token(F.col(c).cast("string")))
    defense = s.defense.select("position", "Team", "o", number("PTS").alias("opp_pts_allowed"), number("REB").alias("opp_reb_allowed"), number("AST").alias("opp_ast_allowed"), number("PTS").alias("opp_fd_allowed"))
    found = resolve.prefer_exact(found, defense, "position", "_key", "_alias", "Team", ALLOWED, "o")
    numeric = [F.coalesce(f"{r}_roll_avg", F.lit(0.0)).alias(c) for c, r in RECENT_OF.items()]
    context = [F.col(c).cast("double").alias(c) for c in CONTEXT]
    status = status_of("found", "has_averages", "has_game")
    found = found.withColumn("has_game", F.col("opponent").isNotNull())
    return found.select("request_id", "name", "player_id", "position", "opponent", status.alias("status"), *numeric, *context)


def predict_own(features: DataFrame, entity: str, target: str, copies: int = 100, seed: int = 42, names: list[str] | None = None) -> DataFrame:
    """(entity, model, prediction, mae, score): each row of features(entity, `target`, the 18 features) by models of its own noisy copies, 80 % of which they learn from.

    `target` is the column with the name of each row's statistic (a key of TARGETS). The entity must be different in all rows."""
    able = features.withColumn("_test", split_scale.test_copies([entity], copies, 0.2, seed))
    rows = training_rows(able, entity, copies, seed)
    label = F.coalesce(*(F.when(F.col(target) == k, F.col(v)) for k, v in TARGETS.items()))
    role = F.when(F.array_contains("_test", F.col("copy")), 1).otherwise(0)
    rows = rows.select(entity, "copy", *FEATURES, label.alias("_label"), role.alias("_role"))
    asked = features.select(entity, F.lit(-1).alias("copy"), *FEATURES, F.lit(None).cast("double").alias("_label"), F.lit(2).alias("_role"))
    return entity_models.predictions(rows.unionByName(asked), entity, FEATURES, "_label", "_role", "copy", names, features.count())


def predict_requests(requests: DataFrame, s: Sources, copies: int = 100, seed: int = 42, names: list[str] | None = None, aliases: dict[str, str] | None = None, scope: str = "pooled") -> DataFrame:
    """requests(request_id, name, stat, spread, total), from names to predictions: a record for each (see result_record()).

    With scope "pooled" the models of a statistic are trained on the noisy rows of all its requests that can be scored, with "entity" each request has
    models of its own rows. A statistic that is not known has the status bad_stat; rows that can't be scored have null predictions."""
    if scope not in ("pooled", "entity"):
        raise ValueError(f"unknown scope: {scope}")
    stat = F.lower(F.trim("stat"))
    asked = requests.withColumn("stat", F.when(stat.isin(*TARGETS), stat))
    f = settled(request_features(asked, s, aliases).join(asked.select("request_id", "stat"), "request_id"))
    ok = f.filter((F.col("status") == "ok") & F.col("stat").isNotNull())
    found = []
    if scope == "entity":
        found.append((predict_own(ok.select("request_id", "stat", *FEATURES), "request_id", "stat", copies, seed, names), None))
    else:

        def trained(name: str) -> tuple[DataFrame, DataFrame]:
            boosting.BESIDE.set(len(stats))
            own = ok.filter(F.col("stat") == name).select("request_id", *FEATURES)
            scorers, report = fit(own, "request_id", name, copies, seed, names)
            return models.score_long(own, scorers, "request_id"), report.select("model", F.col("r2").alias("score"))

        stats = sorted(r["stat"] for r in ok.select("stat").distinct().collect())  # four at most
        # Training is a chain of small jobs; the statistics' chains run side by side.
        with ThreadPoolExecutor(max_workers=len(TARGETS)) as pool:
            found = list(pool.map(trained, stats))
    out = []
    for long, scores in found:
        # One aggregation: a second one beside it would fit, or score, all models again.
        each = F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "prediction")))).alias("individual_predictions")  # at most six
        out.append(ensemble.combine(long, "request_id", scores, each))
    status = F.when((F.col("status") == "ok") & F.col("stat").isNull(), "bad_stat").otherwise(F.col("status"))
    if not out:
        kinds = "prediction double, spread double, mean_score double, n_models long, confidence double, individual_predictions map<string, double>"
        return result_record(f.withColumn("status", status).withColumns({c.split(" ", 1)[0]: F.lit(None).cast(c.split(" ", 1)[1]) for c in kinds.split(", ", 5) if c.split(" ", 1)[0] != "spread"}))
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return result_record(f.withColumn("status", status).join(out[0].drop("spread"), "request_id", "left"))


def result_record(df: DataFrame) -> DataFrame:
    """The shape of an answer: request_id, player, status, target_stat, prediction, confidence, usage_rate, game_context (opponent,
    is_home, spread, total) and individual_predictions by model."""
    context = F.struct("opponent", F.col("is_home").cast("int").alias("is_home"), "spread", "total").alias("game_context")
    return df.select("request_id", F.col("name").alias("player"), "status", F.col("stat").alias("target_stat"), "prediction", "confidence", "usage_rate", context, "individual_predictions")
