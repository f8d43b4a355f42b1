"""Rolling means batch after batch from stored state, and by chunks, against one window over the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from quillcast.operators import rolling
from quillcast.plans import rolling_log

SCHEMA = "k long, player string, day int, pts double, extra string"
ARGS = ("player", ["day", "k"], ["pts"])


def games(n=600, hot=0.34):
    """One player has a third of all rows; null players, null and repeated days, null points."""
    r = random.Random(5)
    out = []
    for k in range(n):
        player = "hot" if r.random() < hot else r.choice(["a", "b", "c", None, ""])
        out.append((k, player, r.choice([None, *range(50)]), r.choice([None, *map(float, range(30))]), "x" * (k % 3)))
    return out


def plain(df):
    return sorted(((r.k, r.player, r.day, None if r.pts_roll_avg is None else round(r.pts_roll_avg, 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 5, 60])
def test_batches_equal_one_window(spark, tmp_path, n):
    log = spark.createDataFrame(games(), SCHEMA)
    path = str(tmp_path / "log")
    for k in range(5):
        batch = log.filter(F.coalesce(F.floor(F.col("day") / 10), F.lit(0)) == k)
        assert rolling_log.append(batch, path, *ARGS, n=n).number == k + 1
    assert plain(rolling_log.rows(spark, path)) == plain(rolling.rolling_means(log, *ARGS, n=n))
    assert rolling_log.late(spark, path) is None
    last = {r.player: r.n for r in rolling_log.state(spark, path).groupBy("player").agg(F.count("*").alias("n")).collect()}
    assert last == {r.player: min(r["count"], n) for r in log.groupBy("player").count().collect()}


@pytest.mark.parametrize("n", [1, 2, 5, 60])
@pytest.mark.parametrize("chunk", ["coalesce(day, -1)", "coalesce(floor(day / 7), -1)", "1"])
def test_chunks_equal_one_window(spark, n, chunk):
    log = spark.createDataFrame(games(), SCHEMA)
    assert plain(rolling.rolling_means_chunked(log, *ARGS, F.expr(chunk), n=n)) == plain(rolling.rolling_means(log, *ARGS, n=n))


def test_a_batch_that_comes_again_is_late(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(1, "a", 1, 2.0, ""), (2, "a", 2, 4.0, ""), (3, "b", 9, 5.0, "")]
    first = spark.createDataFrame(rows, SCHEMA)
    rolling_log.append(first, path, *ARGS)
    rolling_log.append(first, path, *ARGS)
    assert plain(rolling_log.rows(spark, path)) == [(1, "a", 1, 2.0), (2, "a", 2, 3.0), (3, "b", 9, 5.0)]
    assert [(r.k, r.pts_roll_avg) for r in rolling_log.late(spark, path).orderBy("k").collect()] == [(1, None), (2, None), (3, None)]
    # b has no new row and stays; a late row of a changes no mean.
    rolling_log.append(spark.createDataFrame([(4, "a", 3, 9.0, ""), (5, "a", 0, 100.0, "")], SCHEMA), path, *ARGS)
    assert plain(rolling_log.rows(spark, path))[-1] == (4, "a", 3, 5.0) and rolling_log.late(spark, path).count() == 4
    assert {r.player for r in rolling_log.state(spark, path).collect()} == {"a", "b"}
    assert rolling_log.expire_states(spark, path, keep=1) == 2 and rolling_log.rows(spark, path).count() == 4 and rolling_log.state(spark, path).count() == 4


def test_a_writer_that_fails_leaves_the_log_as_it_was(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([(1, "a", 1, 2.0, "")], SCHEMA)
    rolling_log.append(first, path, *ARGS)
    with pytest.raises(Exception):
        rolling_log.append(first.withColumn("pts", F.expr("if(k = 1, raise_error('no'), pts)")), path, *ARGS)
    assert rolling_log.rows(spark, path).count() == 1
    assert rolling_log.append(spark.createDataFrame([(2, "a", 2, 4.0, "")], SCHEMA), path, *ARGS).number == 2
    assert plain(rolling_log.rows(spark, path)) == [(1, "a", 1, 2.0), (2, "a", 2, 3.0)]


def test_empty_batches_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    none = spark.createDataFrame([], SCHEMA)
    assert rolling_log.append(none, path, *ARGS) is None and rolling_log.rows(spark, path) is None and rolling_log.state(spark, path) is None
    rolling_log.append(spark.createDataFrame([(1, "a", 1, 2.0, "")], SCHEMA), path, *ARGS)
    assert rolling_log.append(none, path, *ARGS).number == 2 and rolling_log.state(spark, path).count() == 1
    wider = spark.createDataFrame([(2, "a", 2, 4.0, "", 7.0)], SCHEMA + ", reb double")
    rolling_log.append(wider, path, "player", ["day", "k"], ["pts", "reb"])
    assert [(r.k, r.pts_roll_avg, r.reb_roll_avg) for r in rolling_log.rows(spark, path).orderBy("k").collect()] == [(1, 2.0, None), (2, 3.0, 7.0)]


def test_a_step_shuffles_once(spark):
    new = spark.createDataFrame(games(50), SCHEMA)
    state = rolling.rolling_step(None, new, *ARGS).filter("part = 'state'")
    out = rolling.rolling_step(spark.createDataFrame(state.collect(), state.schema), new, *ARGS)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
