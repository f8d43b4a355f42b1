"""Six regressors as Spark jobs over one feature table.

linear and bayesian are solved from one matrix of sums (gram.py), forest, gbt, hist_level and hist_leaf are
histogram trees (boosting.py): gbt with leaves that are plain means, hist_level and hist_leaf with shrunken ones. entity_affine() is the closed form for each entity on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.operators import gram
from quillcast.operators.boosting import BESIDE, SHARED, TREES, Shared, fit_forest, fit_histogram

SEED = 42
MODELS = ["linear", "bayesian", "forest", "gbt", "hist_level", "hist_leaf"]
BOOSTED = ["gbt", "hist_level", "hist_leaf"]
Scorer = Callable[[DataFrame], DataFrame]


def _affine(coefficients: list[float], intercept: float, features: list[str]) -> Scorer:
    def score(rows: DataFrame) -> DataFrame:
        p = F.lit(float(intercept))
        for c, w in zip(features, coefficients):
            p = p + F.col(c) * F.lit(float(w))
        return rows.withColumn("prediction", p)

    return score


def _from_gram(solve: Callable[[gram.Block], tuple[np.ndarray, float]]) -> Callable[[DataFrame, list[str], str], Scorer]:
    def fit(df: DataFrame, features: list[str], label: str) -> Scorer:
        found = (SHARED.get() or gram).gram(df, [*features, label])
        if found is None:
            raise ValueError("no row has all features and a label")
        w, intercept = solve(found)
        return _affine(w.tolist(), intercept, features)

    return fit


ESTIMATORS: dict[str, Callable[[DataFrame, list[str], str], Scorer]] = {
    "linear": _from_gram(gram.least_squares),
    "bayesian": _from_gram(gram.evidence_ridge),
    "forest": fit_forest(TREES, 8, seed=SEED),
    "gbt": fit_histogram("level", lam=0.0),
    "hist_level": fit_histogram("level"),
    "hist_leaf": fit_histogram("leaf"),
}


def fit_all(train: DataFrame, features: list[str], label: str, models: list[str] | None = None) -> tuple[dict[str, Scorer], dict[str, str]]:
    """(scorers, status) by model. A model that fails is left out of the scorers and has its error as status.

    Models are fitted side by side; each of the boosted ones takes its share of the slots, and leaves the forest one, which goes on while they wait for messages. Several models
    of trees share bins and binned rows, the linear ones the matrix of sums."""
    names = models or MODELS
    share = BESIDE.get() * max(1, len({"forest", *BOOSTED} & set(names)))
    shared = Shared() if len({"forest", *BOOSTED} & set(names)) > 1 or {"linear", "bayesian"} <= set(names) else None

    def fitted(name: str) -> tuple[Scorer | None, str]:
        BESIDE.set(share)
        SHARED.set(shared)
        try:
            return ESTIMATORS[name](train, features, label), "ok"
        except Exception as e:  # one model's failure leaves the others
            return None, f"{type(e).__name__}: {e}"[:200]

    with ThreadPoolExecutor(max_workers=len(names)) as pool:
        found = dict(zip(names, pool.map(fitted, names)))
    if shared:
        shared.close()
    return {m: f for m, (f, _) in found.items() if f}, {m: s for m, (_, s) in found.items()}


def score_long(rows: DataFrame, scorers: dict[str, Scorer], *keys: str) -> DataFrame:
    """(keys, model, prediction) of every scorer, in one pass over the rows; ValueError without one."""
    if not scorers:
        raise ValueError("no model could be fitted")
    rows = rows.drop("prediction")
    for k, s in enumerate(scorers.values()):
        rows = s(rows).withColumnRenamed("prediction", f"_prediction{k}")
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"_prediction{k}").cast("double").alias("prediction")) for k, m in enumerate(scorers)))
    return rows.select(*keys, F.explode(each).alias("_x")).select(*keys, "_x.*")


def entity_affine(train: DataFrame, entity: str, features: list[str], label: str, solve: Callable[[gram.Block], tuple[np.ndarray, float]] = gram.least_squares) -> DataFrame:
    """(entity, n, coefficients, intercept) of each entity's own rows: least squares of least norm, or `solve` (evidence_ridge for the Bayesian model).

    Rows become blocks of sums where they are; an entity's blocks, one for each task with rows of it, are shuffled, merged and solved in
    a task. Features that don't vary within an entity have coefficient 0. Rows with a null or NaN take no part."""
    rows = gram.gram_by(train, entity, [*features, label])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram.total(b) for b in batch.column(1).to_pylist()]
            out = [solve(b) for b in found]
            columns = [batch.column(0), pa.array([b[0] for b in found], pa.int64()), pa.array([w.tolist() for w, _ in out], pa.list_(pa.float64())), pa.array([i for _, i in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["entity", "n", "coefficients", "intercept"])

    kind = rows.schema["entity"].dataType.simpleString()
    return rows.mapInArrow(run, f"entity {kind}, n long, coefficients array<double>, intercept double").withColumnRenamed("entity", entity)


def score_affine(rows: DataFrame, fitted: DataFrame, entity: str, features: list[str]) -> DataFrame:
    """rows with `prediction` of its entity's model from entity_affine(); null for an entity without one."""
    f = fitted.select(F.col(entity).alias("_e"), F.col("coefficients").alias("_w"), F.col("intercept").alias("_i"))
    value = F.col("_i")
    for k, c in enumerate(features):
        value = value + F.col(c) * F.get("_w", F.lit(k))
    return rows.join(f, F.col(entity).eqNullSafe(F.col("_e")), "left").withColumn("prediction", value).drop("_e", "_w", "_i")
