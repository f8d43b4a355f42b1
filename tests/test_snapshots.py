"""Snapshots: versions, readers that outlive a refresh, retention, writers that meet, and pruning of folders."""

from datetime import UTC, datetime, timedelta

import pytest

from quillcast.sources import snapshots, tables


def test_versions_and_readers_that_outlive_them(spark, tmp_path):
    path, now = str(tmp_path / "t"), datetime.now(UTC)
    assert snapshots.read(spark, path) is None and snapshots.versions(spark, path) == []
    assert snapshots.publish(spark.range(10).toDF("k"), path, now=now - timedelta(hours=50)).number == 1
    reader = snapshots.read(spark, path).selectExpr("sum(k) AS s")  # planned before the refresh
    assert snapshots.publish(spark.range(20).toDF("k"), path, now=now - timedelta(hours=1)).number == 2
    assert snapshots.expire(spark, path, keep=1, hours=24, now=now) == []  # replaced only an hour ago
    assert reader.first().s == 45 and snapshots.read(spark, path).count() == 20 and snapshots.read(spark, path, 1).count() == 10
    assert snapshots.publish(spark.range(0).toDF("k"), path) is None and snapshots.read(spark, path).count() == 20
    assert snapshots.publish(spark.range(30).toDF("k"), path, now=now).number == 3
    assert snapshots.expire(spark, path, keep=2, hours=0.5, now=now) == [1] and [v.number for v in snapshots.versions(spark, path)] == [2, 3]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("built=")]) == 2


def test_a_version_that_is_not_complete_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.publish(spark.range(3).toDF("k"), path)
    (tmp_path / "t" / "_versions" / "000000000002.json").write_text('{"number": 2')
    assert snapshots.read(spark, path).count() == 3
    assert snapshots.publish(spark.range(5).toDF("k"), path).number == 3 and snapshots.read(spark, path).count() == 5


def test_a_failed_build_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(Exception):
        snapshots.publish(spark.range(3).selectExpr("raise_error('no') AS k"), path)
    assert snapshots.versions(spark, path) == [] and not [p for p in (tmp_path / "t").glob("built=*")]


def test_a_refresh_while_a_reader_is_planned(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.materialize(spark, lambda: spark.range(4).toDF("k"), path)
    old = tables.materialize(spark, lambda: spark.range(9).toDF("k"), path).selectExpr("count(*) AS n")
    assert tables.materialize(spark, lambda: spark.range(9).toDF("k"), path, force=True).count() == 9
    assert old.first().n == 4


def test_only_the_files_of_a_folder_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).selectExpr("id AS k", "id % 4 AS g")
    snapshots.publish(df.repartition("g"), path, ("g",))
    stored = snapshots.read(spark, path)
    one = tables.partition_of(stored, "g", 3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(g" in plan and "InMemoryFileIndex(1 paths)" in plan
    assert one.count() == 25 and len(one.inputFiles()) == 4  # inputFiles lists the table; the scan reads one folder
    wanted = spark.createDataFrame([(2, "x")], "g int, name string").filter("name = 'x'")
    joined = stored.join(wanted.hint("broadcast"), "g")
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 25
