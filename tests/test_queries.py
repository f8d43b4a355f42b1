"""Every query with SQL against DuckDB on the smallest tables; every other one for rows and a schema."""

import datetime
import decimal
import json
import os

import pytest

import __spark_entry__ as entry_point
from quillcast import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Four times six models: test_requests_train_every_model runs it with models that cost nothing, test_predictions_from_names with real ones on a fixture.
SLOW = {"predict_requests"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE) - SLOW))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_point(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(registry.QUERIES) <= set(entry_point.queries())


def test_no_nested_loop_join_for_home_or_visitor(spark):
    plan = registry.QUERIES["or_join_rewrite"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["category_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,PROMO)]" in plan and "p_retailprice" not in plan


def test_forecast_queries_train_every_model_on_every_copy(spark, monkeypatch):
    from quillcast.operators import models

    sizes = []

    def fit(df, features, label):
        sizes.append(df.count())
        return models._affine([0.0] * len(features), 1.0, features)

    for m in models.MODELS:
        monkeypatch.setitem(models.ESTIMATORS, m, fit)
    assert {r.n_models for r in registry.QUERIES["predict_batch"](spark, DATA).collect() if r.status == "ok"} == {6}
    assert {r.model for r in registry.QUERIES["score_long"](spark, DATA).collect()} == set(models.MODELS)
    assert {r.model for r in registry.QUERIES["model_report"](spark, DATA).collect()} == set(models.MODELS)
    for m in models.MODELS:
        assert [r.model for r in registry.QUERIES[f"fit_{m}"](spark, DATA).collect()] == [m]
    rows = 100 * spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert len(sizes) == 24 and all(0.75 * rows < n < 0.85 * rows for n in sizes)


def test_requests_train_every_model(spark, monkeypatch):
    from quillcast.operators import models

    for m in models.MODELS:
        monkeypatch.setitem(models.ESTIMATORS, m, lambda df, features, label: models._affine([0.0] * len(features), 1.0, features))
    got = registry.QUERIES["predict_requests"](spark, DATA).collect()
    ok = [r for r in got if r.status == "ok"]
    assert len(got) == spark.read.parquet(f"{DATA}/customer.parquet").count() and {r.target_stat for r in ok} == {"points", "rebounds", "assists", "fantasy"}
    assert all(set(json.loads(r.individual_predictions)) == set(models.MODELS) and r.prediction == 1.0 for r in ok)
    assert {"ok", "not_found", "no_game"} <= {r.status for r in got} and all(r.prediction is None for r in got if r.status != "ok")
