"""Boosting, sums of products, splits, noise, lookups and small ensembles against plain definitions and under other partitionings."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcast.functions.values import noises
from quillcast.operators import boosting, ensemble, entity_models, gram, models, resolve, small_trees, split_scale
from quillcast.operators.augment import FEATURES
from quillcast.plans import forecast


def wave(n=600, seed=8):
    x = np.random.default_rng(seed).normal(0, 1, (n, 2))
    return [(float(a), float(b), float(np.sin(2 * a) + 0.3 * b)) for a, b in x]


def plain_boosting(x, y, trees, depth, lam, least, rate=0.1):
    """Boosted trees over binned features, one node at a time."""
    out, wide = np.full(len(y), float(np.float32(np.mean(y)))), int(x.max()) + 1

    def grow(rows, g, level, step):
        s = np.zeros((x.shape[1], wide, 2))
        for f in range(x.shape[1]):
            np.add.at(s[f, :, 0], x[rows, f], g[rows])
            np.add.at(s[f, :, 1], x[rows, f], 1)
        gain, f, b = boosting.best_split(s, lam, least) if level < depth else (0.0, -1, -1)
        if gain <= 1e-12:
            step[rows] = -g[rows].sum() / (len(rows) + lam)
            return
        low = x[rows, f] <= b
        grow(rows[low], g, level + 1, step)
        grow(rows[~low], g, level + 1, step)

    for _ in range(trees):
        step = np.zeros(len(y))
        grow(np.arange(len(y)), out - y, 0, step)
        out = out + rate * step
    return out


@pytest.mark.parametrize("growth,lam,least", [("level", 1.0, 1), ("level", 0.0, 1), ("leaf", 1.0, 20)])
def test_one_barrier_job_equals_a_plain_booster_and_a_job_for_each_level(spark, growth, lam, least):
    rows = wave()
    df = spark.createDataFrame(rows, "a double, b double, y double")
    edges = boosting.bin_edges(df, ["a", "b"])
    x = np.column_stack([np.searchsorted(e, [r[k] for r in rows], "left") for k, e in enumerate(edges)])
    want = dict(zip([r[:2] for r in rows], plain_boosting(x, np.array([r[2] for r in rows]), 4, 3, lam, least)))
    for barrier in (True, False):
        fit = boosting.fit_histogram(growth, trees=4, depth=3, lam=lam, barrier=barrier)
        got = {(r.a, r.b): r.prediction for r in fit(df.repartition(3), ["a", "b"], "y")(df).collect()}
        assert got == pytest.approx(want, abs=1e-6)


def test_several_tasks_of_a_barrier_job_grow_the_trees_of_one(spark, monkeypatch):
    monkeypatch.setattr(boosting, "LEAST_ROWS", 200)
    df = spark.createDataFrame(wave(900), "a double, b double, y double")
    fit = boosting.fit_histogram("level", trees=5, depth=4)
    many = [r.prediction for r in fit(df.repartition(6), ["a", "b"], "y")(df).collect()]
    monkeypatch.setattr(boosting, "LEAST_ROWS", 10**9)
    assert many == [r.prediction for r in fit(df.coalesce(1), ["a", "b"], "y")(df).collect()]


def test_bins_do_not_depend_on_partitions_and_are_near_the_quantiles(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(1000, 1, 5000), rng.lognormal(0, 2, 5000), np.full(5000, 7.0), rng.integers(0, 3, 5000)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, float("nan"), None, None)], "a double, b double, c double, d double")
    got = [boosting.bin_edges(df.repartition(n), list("abcd")) for n in (1, 64)]
    assert got[0] == got[1] and [len(e) for e in got[0]] == [31, 31, 1, 3]
    for k in range(2):
        share = np.searchsorted(np.sort(x[:, k]), got[0][k], "right") / 5000
        assert np.abs(share - np.arange(1, 32) / 32).max() < 0.005
    assert boosting.bin_edges(df.limit(0), ["a"]) == [[]]


def test_sums_of_products(spark, monkeypatch):
    rng = np.random.default_rng(5)
    z = rng.normal(1e6, 1, (3000, 4))
    df = spark.createDataFrame([(k % 7, *map(float, r)) for k, r in enumerate(z)] + [(0, 1.0, None, 1.0, 1.0), (1, float("nan"), 1.0, 1.0, 1.0)], "e long, a double, b double, c double, y double")
    monkeypatch.setattr(gram, "FAN_IN", 3)
    n, mean, c = gram.gram(df.repartition(11), list("abcy"))
    assert n == 3000 and np.allclose(mean, z.mean(0), rtol=1e-12) and np.allclose(c, np.cov(z.T) * 2999, rtol=1e-6, atol=1e-4)
    monkeypatch.setattr(gram, "HELD", 2)
    for r in gram.gram_by(df.repartition(5), "e", list("abcy")).collect():
        n, mean, c = gram.total(r["blocks"])
        own = z[np.arange(3000) % 7 == r["entity"]]
        assert n == len(own) and np.allclose(c, np.cov(own.T) * (n - 1), rtol=1e-6, atol=1e-4)
    assert gram.gram(df.limit(0), ["a", "y"]) is None
    ridge = models.entity_affine(df, "e", ["a", "b"], "y", gram.evidence_ridge)
    assert ridge.count() == 7 and all(np.isfinite(r.coefficients).all() for r in ridge.collect())


def test_evidence_ridge_by_its_fixed_point():
    """Weights are those of ridge regression at the precisions that the evidence settles on; a strong signal is hardly shrunk."""
    rng = np.random.default_rng(6)
    x = rng.normal(5, 2, (200, 3))
    y = x @ [2.0, -1.0, 0.0] + 3 + rng.normal(0, 0.1, 200)
    w, intercept = gram.evidence_ridge(gram.block(np.column_stack([x, y])))
    assert np.allclose(w, [2, -1, 0], atol=0.02) and intercept == pytest.approx(3, abs=0.1)
    w, intercept = gram.evidence_ridge(gram.block(np.column_stack([x, np.full(200, 4.0)])))
    assert np.allclose(w, 0) and intercept == 4
    w, _ = gram.evidence_ridge(gram.block(np.column_stack([x[:, :2], np.full(200, 9.0), y])))
    assert w[2] == 0


@pytest.mark.parametrize("n", [0, 1, 4, 5, 1003])
def test_pooled_split_is_exact(spark, n):
    df = spark.range(n).withColumn("copy", F.lit(1))
    got = split_scale.pooled_split(df.repartition(5), ["id", "copy"])
    first = {r.id for r in got.filter("is_test").collect()}
    assert len(first) == math.ceil(0.2 * n) and got.count() == n
    assert first == {r.id for r in split_scale.pooled_split(df.coalesce(1), ["id", "copy"]).filter("is_test").collect()}
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString() and "Exchange hash" not in split_scale.pooled_split(df, ["id"])._jdf.queryExecution().executedPlan().toString()


def test_split_of_few_hashes_at_a_time_and_of_equal_keys(spark):
    df = spark.range(5000)
    h, cut = split_scale.hash_cut(df, ["id"], few=0)
    assert df.filter(h <= cut).count() == 1000
    same = df.select(F.lit(1).alias("id"))
    assert {r.is_test for r in split_scale.pooled_split(same, ["id"]).collect()} == {True}


def test_copies_are_split_exactly_within_each_row(spark):
    df = spark.range(50).withColumn("t", split_scale.test_copies(["id"], 100))
    got = [r.t for r in df.collect()]
    assert all(len(set(t)) == 20 and set(t) <= set(range(100)) for t in got) and len(set(map(tuple, got))) == 50


def test_counter_noise(spark):
    df = spark.range(20000)
    u = noises("counter", {k: (0.8, 1.2) for k in "abcd"}, 42, "s", F.col("id"))
    x = np.array(df.select(*(u[k].alias(k) for k in "abcd")).collect())
    assert x.min() >= 0.8 and x.max() < 1.2 and np.abs(x.mean(0) - 1).max() < 0.005 and np.abs(np.corrcoef(x.T) - np.eye(4)).max() < 0.03
    assert len({tuple(r) for r in x.tolist()}) == 20000
    with pytest.raises(ValueError):
        noises("other", {}, 1, "s")


def test_a_last_word_that_all_share_costs_a_sum_and_not_a_product(spark):
    """10^5 queries and 10^5 names with one last word: 10^10 pairs, if queries met all names that hold it."""
    n = 100_000
    names = spark.range(n).select(F.concat(F.lit("N"), F.col("id").cast("string"), F.lit(" SMITH")).alias("name"), F.col("id").alias("o"))
    asked = spark.range(n).select(F.concat(F.lit("Q"), F.col("id").cast("string"), F.lit(" smith")).alias("q"))
    began = time.time()
    got = resolve.resolve(asked, names, "q", "name", "o").groupBy("tier", "match.o").count().collect()
    assert [tuple(r) for r in got] == [(3, 0, n)] and time.time() - began < 120


def test_one_lookup_in_several_references(spark):
    a = spark.createDataFrame([("Ann Roe", 1, 10), ("Bob Roe", 2, 20)], "name string, o int, v int")
    b = spark.createDataFrame([("Al Roe", 5), ("Ann Roe Jr", 7)], "who string, o int")
    asked = spark.createDataFrame([("ann roe",), ("x ROE",), ("al",), (None,), ("",)], "q string")
    got = {r.q: r for r in resolve.resolve_in(asked, "q", {"a": resolve.Reference(a, "name", "o"), "b": resolve.Reference(b, "who", "o"), "c": resolve.Reference(a, "name", "o", (1,))}).collect()}
    assert (got["ann roe"].a.tier, got["ann roe"].a.match.v, got["ann roe"].b.tier, got["ann roe"].b.match.o, got["ann roe"].c.match.v) == (1, 10, 2, 7, 10)
    assert (got["x ROE"].a.tier, got["x ROE"].a.match.o, got["x ROE"].b.match.who, got["x ROE"].c) == (3, 1, "Al Roe", None)
    assert got["al"].a is None and got["al"].b.match.o == 5 and got[None].a is None and got[""].b is None


def small_groups(n=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (3, n * 50))
    y = 3 * x[0] + np.sin(6 * x[1])
    role = np.tile(np.array([0] * 40 + [1] * 9 + [2]), n)
    return x, y, np.repeat(np.arange(n), 50), role


@pytest.mark.parametrize("depth,lam,least", [(6, 0.0, 1), (6, 1.0, 20), (2, 1.0, 1)])
def test_trees_of_many_groups_by_a_plain_booster(depth, lam, least):
    x, y, group, role = small_groups()
    d = small_trees.Groups(x, y, group, role == 0, np.arange(5, dtype=np.uint64))
    got = small_trees.boosted(d, x, 3, 0.1, depth, lam, least)
    for k in range(5):
        own = np.flatnonzero((group == k) & d.train)
        ranks = np.stack([np.unique(v[own], return_inverse=True)[1] for v in x]).T
        mean = y[own].mean()
        assert np.allclose(got[own], plain_boosting(ranks, y[own] - mean, 3, depth, lam, least) + mean, atol=1e-6)
    alone = [small_trees.boosted(small_trees.Groups(x[:, group == k], y[group == k], np.zeros(50, int), (role == 0)[group == k], np.array([k], np.uint64)), x[:, group == k], 3, 0.1, depth, lam, least) for k in range(5)]
    assert np.allclose(got, np.concatenate(alone))


def test_leaf_wise_trees_of_groups_stop_at_their_leaves():
    x, y, group, role = small_groups()
    d = small_trees.Groups(x, y, group, role == 0, np.arange(5, dtype=np.uint64))
    g = np.where(d.train, d.mean[group] - y, 0.0)
    got = small_trees.tree_values(x, d.ordered(x), group, g, d.weight, 6, 1.0, 1, leaves=4)
    for k in range(5):
        own = np.flatnonzero((group == k) & d.train)
        found = [(own, 0)]
        ranks = np.stack([np.unique(v[own], return_inverse=True)[1] for v in x])
        place = {r: i for i, r in enumerate(own.tolist())}

        def split(rows, level):
            at = [place[r] for r in rows.tolist()]
            s = np.zeros((3, 40, 2))
            for f in range(3):
                np.add.at(s[f, :, 0], ranks[f, at], g[rows])
                np.add.at(s[f, :, 1], ranks[f, at], 1)
            return (*(boosting.best_split(s, 1.0, 1) if level < 6 else (0.0, -1, -1)), rows, level)

        found = [split(own, 0)]
        while len(found) < 4:
            _, f, b, rows, level = found.pop(int(np.argmax([q[0] for q in found])))
            low = ranks[f, [place[r] for r in rows.tolist()]] <= b
            found += [split(rows[low], level + 1), split(rows[~low], level + 1)]
        for *_, rows, _ in found:
            assert np.allclose(got[rows], -g[rows].sum() / (len(rows) + 1))


def test_forests_are_repeatable_and_fit():
    x, y, group, role = small_groups()
    fit = lambda keep: small_trees.forest(small_trees.Groups(x[:, keep], y[keep], np.unique(group[keep], return_inverse=True)[1], (role == 0)[keep], np.unique(group[keep]).astype(np.uint64)), 20, 8)
    every, one = fit(group >= 0), fit(group == 3)
    assert np.allclose(every[group == 3], one)
    test = role == 1
    assert 1 - ((every[test] - y[test]) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum() > 0.7


def test_six_models_of_own_rows_do_not_depend_on_the_bundle(spark, monkeypatch):
    rows = [{c: float(1 + (k * (i + 3)) % 17) for i, c in enumerate(FEATURES)} | {"e": k, "stat": ["points", "fantasy"][k % 2]} for k in range(6)]
    f = spark.createDataFrame(rows)
    many = forecast.predict_own(f, "e", "stat", copies=40)
    got = {(r.e, r.model): (r.prediction, r.mae, r.score) for r in many.collect()}
    assert len(got) == 36 and {m for _, m in got} == set(models.MODELS) and all(np.isfinite(v).all() for v in got.values())
    monkeypatch.setattr(entity_models, "BUNDLE", 1)
    alone = {(r.e, r.model): (r.prediction, r.mae, r.score) for r in forecast.predict_own(f.filter("e = 3"), "e", "stat", copies=40).collect()}
    assert {k: v for k, v in got.items() if k[0] == 3} == {k: pytest.approx(v, rel=1e-9) for k, v in alone.items()}
    assert forecast.predict_own(f.limit(0), "e", "stat", copies=40).count() == 0


def test_six_real_models_of_all_rows(spark):
    """The whole forecast with six trained models, on few rows and copies."""
    rows = [{c: float(5 + (k * (i + 3)) % 17) for i, c in enumerate(FEATURES)} | {"e": k} for k in range(8)]
    f = spark.createDataFrame(rows)
    asked = f.selectExpr("e", "e <> 1 found", "true averages", "true game")
    got = {r.e: r for r in forecast.predict(asked, f, "e", "points", copies=30).collect()}
    assert got[1].status == "not_found" and got[1].prediction is None
    assert all(r.n_models == 6 and math.isfinite(r.prediction) and 60 <= r.confidence <= 99 for k, r in got.items() if k != 1)


def test_a_forest_of_undrawn_rows_is_one_plain_tree(spark):
    """With each row drawn once all trees are the tree that plain boosting begins with, whatever the partitions are."""
    rows = wave(700)
    df = spark.createDataFrame(rows, "a double, b double, y double")
    edges = boosting.bin_edges(df, ["a", "b"])
    x = np.column_stack([np.searchsorted(e, [r[k] for r in rows], "left") for k, e in enumerate(edges)])
    want = dict(zip([r[:2] for r in rows], plain_boosting(x, np.array([r[2] for r in rows]), 1, 4, 0.0, 1, 1.0)))
    got = {(r.a, r.b): r.prediction for r in boosting.fit_forest(3, 4, draws=np.ones(1 << 16, np.uint8))(df.repartition(3), ["a", "b"], "y")(df).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_rows_are_drawn_as_often_as_with_replacement():
    w = boosting._drawn(1 << 20, boosting.DRAWS, 42, 3, 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert (w == boosting._drawn(1 << 20, boosting.DRAWS, 42, 3, 7)).all() and not (w == boosting._drawn(1 << 20, boosting.DRAWS, 42, 4, 7)).all()


def test_of_two_sisters_only_the_smaller_is_counted():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 8, (4000, 3)).astype(np.uint8), rng.normal(0, 1000, 4000)
    s = boosting.Settings("level", 1, 5, 0, 0.1, 1.0)
    s.k, s.wide = 3, 8
    held, counted = boosting._Held(iter([]), s), []
    held.blocks = [boosting._Block(x[:1500], y[:1500], 8), boosting._Block(x[1500:], y[1500:], 8)]

    def sums_of(tree, nodes):
        total = held.sums(tree, nodes)
        counted.append(int(total[:, 0, :, 1].sum()))
        return dict(zip(nodes, total))

    _, whole, gives = boosting.grow_tree(sums_of, "level", 5, 0, 1.0, 1)
    assert counted[0] == 4000 and len(counted) == 5 and all(n <= 2000 for n in counted[1:])
    held.take(whole, gives)
    assert np.allclose(np.concatenate([b.y for b in held.blocks]), y - 0.1 * boosting.values(whole)[boosting.route(whole, x)])


def test_scores_of_models_do_not_shuffle_the_predictions_by_model(spark):
    p = spark.range(100).selectExpr("id % 10 request", "concat('m', id % 2) model", "double(id) prediction")
    out = ensemble.combine(p, "request", spark.createDataFrame([("m0", 0.5)], "model string, score double"))
    assert "hashpartitioning(model" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.request: r.mean_score for r in out.collect()} == {k: pytest.approx(0.8 if k % 2 else 0.5) for k in range(10)}


def test_models_side_by_side_share_bins_and_rows_and_are_those_fitted_alone(spark, monkeypatch):
    df = spark.createDataFrame(wave(500), "a double, b double, y double").repartition(3).persist()
    names, asked, edges = ["forest", "gbt", "hist_leaf"], [], boosting.bin_edges
    monkeypatch.setattr(boosting, "bin_edges", lambda *a: asked.append(1) or edges(*a))
    fits = {"forest": boosting.fit_forest(4, 3), "gbt": boosting.fit_histogram("level", 4, 3, lam=0.0), "hist_leaf": boosting.fit_histogram("leaf", 4, 3, barrier=False)}
    monkeypatch.setattr(models, "ESTIMATORS", fits)
    found, status = models.fit_all(df, ["a", "b"], "y", names)
    assert set(status.values()) == {"ok"} and len(asked) == 1
    for m in ("gbt", "hist_leaf"):
        alone = {(r.a, r.b): r.prediction for r in fits[m](df, ["a", "b"], "y")(df).collect()}
        assert {(r.a, r.b): r.prediction for r in found[m](df).collect()} == alone
    assert len(asked) == 3 and found["forest"](df).count() == 500
    assert boosting.SHARED.get() is None
    df.unpersist()


def test_linear_models_side_by_side_share_the_sums(spark, monkeypatch):
    df, asked, sums = spark.createDataFrame(wave(300), "a double, b double, y double").persist(), [], gram.gram
    monkeypatch.setattr(gram, "gram", lambda *a: asked.append(1) or sums(*a))
    found, _ = models.fit_all(df, ["a", "b"], "y", ["linear", "bayesian"])
    assert len(asked) == 1
    for m in found:
        assert [r.prediction for r in models.ESTIMATORS[m](df, ["a", "b"], "y")(df).collect()] == [r.prediction for r in found[m](df).collect()]
    df.unpersist()


def test_rows_without_weight_stand_in_no_segment_and_follow_the_cuts():
    x, y, group, role = small_groups()
    d = small_trees.Groups(x, y, group, role == 0, np.arange(5, dtype=np.uint64))
    assert d.ordered(x).shape == (3, int(d.train.sum()))
    g = np.where(d.train, np.rint(-d.label), 0.0)
    every = np.stack([np.lexsort((v, group)) for v in x])
    for w, lam, least in ((d.weight, 0.0, 1), (d.weight, 1.0, 5), (d.weight * (1 + np.arange(len(y)) % 3), 0.0, 1)):
        own = small_trees.tree_values(small_trees.ranks(x), small_trees.weighted(every, w), group, g * w, w, 6, lam, least)
        assert np.array_equal(own, small_trees.tree_values(x, every, group, g * w, w, 6, lam, least))


def test_names_that_end_in_numbers_are_not_paired_by_trigrams(spark):
    names = spark.range(2000).select(F.format_string("Player#%09d", "id").alias("name"))
    needles = names.select(F.substring("name", 5, 20).alias("needle")).unionByName(spark.createDataFrame([("01999",), ("99",), ("",), ("r#00000",), ("#0000019",), ("nobody 12",)], "needle string"))
    assert resolve.candidates(needles, names, "needle", "name", False).filter(F.length("needle") > 8).count() <= 3 * 2000
    got = {(r.needle, r.name) for r in resolve.containing(needles, names).collect()}
    every = [r.name for r in names.collect()]
    assert got == {(a, b) for a in {r.needle for r in needles.collect()} for b in every if a and a in b}


def test_sums_get_rows_as_one_array(spark, monkeypatch):
    rows = [(float(k), k % 7, None if k % 5 == 0 else 1.5 * k, float("nan") if k % 11 == 0 else k * k / 3) for k in range(100)]
    df = spark.createDataFrame(rows, "a double, b int, c double, y double")
    seen, whole = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: seen.append(self.dtypes) or whole(self, *a, **k))
    n, mean, c = gram.gram(df.repartition(3), list("abcy"))
    assert seen == [[("z", "array<double>")]]
    z = np.array([r for r in rows if r[2] is not None and r[3] == r[3]], float)
    assert n == len(z) and np.allclose(mean, z.mean(axis=0)) and np.allclose(c, np.cov(z.T, bias=True) * len(z))


def test_gradients_and_rows_add_up_in_one_number_whatever_their_size():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 8, (5000, 3)).astype(np.uint8)
    b, pairs = boosting._Block(x, np.zeros(5000), 8), 2
    for size, w in ((3.0, None), (2.0**31, None), (2.0**38, None), (2.0**30, rng.integers(1, 9, 5000).astype(np.uint8)), (2.0**20, np.full(5000, 250, np.uint8))):
        found, g, place = boosting._Sums(pairs, 4, 8), np.rint(rng.normal(0, size, 5000)), rng.integers(0, 4, 5000)
        for rows in (np.arange(3000), np.arange(3000, 5000), np.arange(5000)):
            found.add(b, rows, place[rows], g[rows], None if w is None else w[rows])
        for p in range(pairs):
            for k, v in enumerate((g, np.ones(5000) if w is None else w)):
                want = np.zeros((4, 64), np.int64)
                np.add.at(want, (place, b.pairs[p]), 2 * v.astype(np.int64))
                assert np.array_equal(found.apart()[k, p], want)


def test_boosted_models_leave_the_forest_a_share_of_the_slots(spark, monkeypatch):
    beside = {}
    monkeypatch.setattr(models, "ESTIMATORS", {m: lambda *a, m=m: beside.update({m: boosting.BESIDE.get()}) for m in models.MODELS})
    models.fit_all(spark.range(1), [], "id", models.MODELS)
    assert beside["gbt"] == 4
    models.fit_all(spark.range(1), [], "id", ["gbt", "linear"])
    assert beside["gbt"] == 1


def test_bins_and_binned_rows_get_features_as_one_array(spark, monkeypatch):
    rows = [(float(k % 50), None if k % 7 == 0 else k % 5, float("nan") if k % 11 == 0 else 1.0 * k, None if k % 13 == 0 else k / 3) for k in range(400)]
    df = spark.createDataFrame(rows, "a double, b int, c double, y double")
    seen, whole = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: seen.append(self.dtypes) or whole(self, *a, **k))
    s = boosting.Settings("level", 1, 2, 0, 0.1, 1.0)
    data, edges, count = boosting._prepare(df.repartition(3), list("abc"), "y", 8, s)
    assert seen == [[("z", "array<double>")]] * 2 and count == sum(r[3] is not None for r in rows)
    got = sorted((*map(int, xs), round(y * s.unit + s.base, 6)) for r in data.collect() for xs, y in zip(np.frombuffer(r["x"], np.uint8).reshape(-1, 3), np.frombuffer(r["y"])))
    low = lambda v: -np.inf if v is None or v != v else float(v)
    assert got == sorted((*(int(np.searchsorted(e, low(v), "left")) for e, v in zip(edges, r)), round(r[3], 6)) for r in rows if r[3] is not None)


def test_a_task_holds_28_bytes_a_row():
    """TASK_ROWS of them must fit: 42,000,000 are as much memory as 2 ** 25 were with 36 bytes, and twelve tasks hold the 432,000,000 rows of 6 GB."""
    x = np.random.default_rng(3).integers(0, 32, (20000, 18)).astype(np.uint8)
    s = boosting.Settings("level", 1, 3, 0, 0.1, 1.0)
    s.k, s.wide = 18, 32
    held = boosting._Held(iter([]), s)
    held.blocks = [boosting._Block(x, x[:, 0] * 1e6, 32)]
    _, whole, gives = boosting.grow_tree(lambda tree, nodes: dict(zip(nodes, held.sums(tree, nodes))), "level", 3, 0, 1.0, 1)
    b = held.blocks[0]
    assert sum(v.nbytes for k, v in vars(b).items() if isinstance(v, np.ndarray) and k != "numbers") <= 28 * len(b)
    assert boosting.TASK_ROWS * 28 <= (1 << 25) * 36 and 12 * boosting.TASK_ROWS >= 432_000_000


def test_sums_of_a_forest_stay_with_the_executors(spark, monkeypatch):
    df, seen, whole = spark.createDataFrame(wave(700), "a double, b double, y double").persist(), [], type(spark.range(1)).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append((self.columns, whole(self))) or seen[-1][1])
    assert boosting.fit_forest(6, 5)(df, ["a", "b"], "y")(df).count() == 700
    assert not any("sums" in c for c, _ in seen)
    sent = [len(r.choices) for c, rows in seen if "choices" in c for r in rows]
    assert len(sent) == 30 and max(sent) < 16 * 100  # at most 16 nodes a tree at the last level
    df.unpersist()


def test_trees_of_a_forest_that_are_done_early_leave_the_others(spark):
    rows = [(float(k), float(k % 2), float(k)) for k in range(5)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    got = [r.prediction for r in boosting.fit_forest(20, 6)(df.coalesce(1), ["a", "b"], "y")(df).collect()]
    assert all(0 <= p <= 4 for p in got) and max(got) - min(got) > 1
    assert boosting.fit_forest(3, 4)(df.limit(0), ["a", "b"], "y")(df).count() == 5


def test_features_that_vary_in_no_group_are_left_out_of_the_cuts(monkeypatch):
    x, y, group, role = small_groups()
    still = np.vstack([group * 1.0, x[:2], np.zeros(len(y)), x[2:]])
    make = lambda v: small_trees.Groups(v, y, group, role == 0, np.arange(5, dtype=np.uint64))
    widths, whole = set(), small_trees.tree_values
    monkeypatch.setattr(small_trees, "tree_values", lambda v, order, *a, **k: widths.add((len(v), len(order))) or whole(v, order, *a, **k))
    assert np.array_equal(small_trees.boosted(make(still), still, 3, 0.1, 6, 0.0, 1), small_trees.boosted(make(x), x, 3, 0.1, 6, 0.0, 1))
    assert np.array_equal(small_trees.forest(make(still), 3, 8), small_trees.forest(make(x), 3, 8)) and widths == {(3, 3)}
    none = np.repeat(group[None] * 1.0, 2, axis=0)
    assert np.allclose(small_trees.boosted(make(none), none, 3, 0.1, 6, 0.0, 1), make(none).mean[group])


def test_training_starts_from_a_plan_of_one_step(spark):
    f = spark.range(40).selectExpr("id % 10 e", "id v").groupBy("e").sum("v")
    out = forecast.settled(f)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "InMemory" not in plan and sorted(map(tuple, out.collect())) == sorted(map(tuple, f.collect()))
    assert not f.is_cached
