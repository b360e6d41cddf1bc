"""Boosted trees and Poisson regression on Spark ML: one model per horizon, search and refit."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, astuple, dataclass, fields, replace
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.functions.checkpoints import with_checkpoint_folder
from slotcast.functions.rows import not_negative
from slotcast.operators.backtest import predicted
from slotcast.operators.features import HORIZONS, ahead, complete

VECTOR = "_features"

# What the search draws from. Penalties on leaf values have no
# counterpart in Spark ML and are left out.
SEARCH_SPACE: Mapping[str, Sequence[float]] = {
    "maxDepth": [3, 4, 5, 6, 8],
    "stepSize": [0.01, 0.02, 0.03, 0.05, 0.1],
    "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
    "featureSubsetStrategy": [0.7, 0.8, 0.9, 1.0],
    "minInstancesPerNode": [1, 3, 5, 7, 10],
    "minInfoGain": [0, 0.05, 0.1, 0.3],
}


@dataclass(frozen=True)
class TreeParams:
    """Settings by the names that Spark ML gives them."""

    maxIter: int = 300
    stepSize: float = 0.05
    maxDepth: int = 4
    minInstancesPerNode: int = 5
    subsamplingRate: float = 0.8
    featureSubsetStrategy: float = 0.8
    minInfoGain: float = 0.0
    seed: int = 42


# Settings of the published squared-error model.
SQUARED = TreeParams()


# Models fitted at a time. Each fit is a row of short jobs that leave executors
# idle between them; the jobs of another fit fill those gaps.
AT_A_TIME = 5

# Rows that are worth a task. Each level of each tree is a job of its own over all partitions of
# the rows, so a small table in the many partitions of a shuffle costs its tasks, not its rows.
ROWS_A_TASK = 20_000


def side_by_side(spark: SparkSession, work: Callable, items: Sequence) -> list:
    """Results of ``work`` for each item, in order, a few at a time."""
    with ThreadPool(max(1, min(AT_A_TIME, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the feature vector and leave out rows that lack a feature."""
    assembler = VectorAssembler(
        inputCols=list(features), outputCol=VECTOR, handleInvalid="skip"
    )
    return assembler.transform(df)


@contextmanager
def kept(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` kept while they are read again and again, in no more partitions than their number asks for."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows.coalesce(max(1, -(-rows.count() // ROWS_A_TASK)))
    finally:
        rows.unpersist()


def squared_trees(params: TreeParams, target: str) -> GBTRegressor:
    settings = asdict(params) | {"featureSubsetStrategy": str(params.featureSubsetStrategy)}
    return GBTRegressor(
        featuresCol=VECTOR, labelCol=target, lossType="squared", checkpointInterval=10, **settings
    )


def fit_squared(
    train: DataFrame, features: Sequence[str], targets: Sequence[str], params: TreeParams = SQUARED
) -> dict[str, GBTRegressionModel]:
    """One squared-error model per target column."""
    spark = with_checkpoint_folder(train.sparkSession)
    with kept(assemble(train, features).select(VECTOR, *targets)) as rows:
        models = side_by_side(
            spark, lambda t: squared_trees(params, t).fit(complete(rows, [t])), targets
        )
    return dict(zip(targets, models))


def save_models(models: Mapping[str, GBTRegressionModel], folder: str) -> None:
    """Keeps the model of each target in a folder of its own below ``folder``,
    which all machines share; models kept there before are replaced."""
    for target, model in models.items():
        model.write().overwrite().save(f"{folder}/{target}")


def load_models(folder: str, targets: Sequence[str]) -> dict[str, GBTRegressionModel]:
    """The models that ``save_models`` has kept, with no fit."""
    return {t: GBTRegressionModel.load(f"{folder}/{t}") for t in targets}


def with_forecasts(
    df: DataFrame, models: Mapping[str, GBTRegressionModel], features: Sequence[str],
    names: Mapping[str, str], clip: bool = True,
) -> DataFrame:
    """``df`` with the forecast of each target under its name, not below 0 where
    ``clip``. Rows that lack a feature are left out."""
    out = assemble(df, features)
    for target, model in models.items():
        out = model.setPredictionCol(names[target]).transform(out)
    if clip:
        out = out.withColumns({names[t]: not_negative(names[t]) for t in models})
    return out.drop(VECTOR)


def forecast_squared(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    params: TreeParams = SQUARED,
    horizons: Sequence[int] = HORIZONS,
    method: str = "trees",
    clip: bool = True,
    folder: str | None = None,
) -> DataFrame:
    """Add a forecast of one squared-error model per horizon, not below 0 where
    ``clip``. With a shared ``folder`` the models are kept there and read back, so
    that later forecasts can use them (``load_models``, ``with_forecasts``)."""
    names = {ahead(h): predicted(h, method) for h in horizons}
    models = fit_squared(train, features, list(names), params)
    if folder is not None:
        save_models(models, folder)
        models = load_models(folder, list(names))
    return with_forecasts(test, models, features, names, clip)


def forecast_counts(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int] = HORIZONS,
    method: str = "counts",
) -> DataFrame:
    """Add a forecast of one Poisson regression with logarithmic link per horizon.

    The published model for counts is a boosted one, which Spark ML lacks for
    this likelihood; this is its linear counterpart. Inputs should not depend on
    each other.
    """
    targets = [ahead(h) for h in horizons]
    with kept(assemble(train, features).select(VECTOR, *targets)) as rows:
        models = side_by_side(
            train.sparkSession,
            lambda t: GeneralizedLinearRegression(
                featuresCol=VECTOR, labelCol=t, family="poisson", link="log", tol=1e-12, maxIter=50
            ).fit(complete(rows, [t])),
            targets,
        )
    out = assemble(test, features)
    for h, model in zip(horizons, models):
        out = model.setPredictionCol(predicted(h, method)).transform(out)
    return out.drop(VECTOR)


def draws(
    n: int, seed: int = 42, space: Mapping[str, Sequence[float]] = SEARCH_SPACE
) -> list[dict[str, float]]:
    """``n`` different combinations, or all if there are fewer."""
    rng = random.Random(seed)
    size = 1
    for values in space.values():
        size *= len(values)
    picked = []
    for index in rng.sample(range(size), min(n, size)):
        combination = {}
        for name, values in space.items():
            index, place = divmod(index, len(values))
            combination[name] = values[place]
        picked.append(combination)
    return picked


def best_round(curve: Sequence[float], patience: int) -> int:
    """Number of trees at the lowest error, looking no further than
    ``patience`` trees past the best one so far."""
    best = 0
    for i, loss in enumerate(curve):
        if loss < curve[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


@dataclass(frozen=True)
class Candidate:
    """Settings with the best number of trees, the error of forecasts not below 0
    with so many trees, and the trees fitted to find it."""

    params: TreeParams
    mae: float
    fitted: int


def clipped_error(model: GBTRegressionModel, check: DataFrame, target: str) -> float:
    """Mean absolute error of the model's forecasts, raised to 0 where below."""
    guess = not_negative("_guess")
    scored = model.setPredictionCol("_guess").transform(check)
    return scored.agg(F.avg(F.abs(F.col(target) - guess))).first()[0]


def staged(
    fit_rows: DataFrame, check: DataFrame, target: str, params: TreeParams, patience: int
) -> Candidate:
    """Fits twice ``patience`` trees, as ``patience`` of them never tell enough, then
    twice as many and so on up to ``params.maxIter``, and stops when the best round
    lies ``patience`` back.

    The round is that of the lowest error before clipping, the candidate's error
    that of the model cut there, after clipping. Fits with one seed share their
    leading trees, so the answer is that of the full fit, for less than five times
    the trees up to the stop.
    """
    trees, fitted = min(params.maxIter, max(1, 2 * patience)), 0
    while True:
        model = squared_trees(replace(params, maxIter=trees), target).fit(fit_rows)
        fitted += trees
        curve = model.evaluateEachIteration(check, "absolute")
        best = best_round(curve, patience)
        if trees >= params.maxIter or trees - best >= patience:
            break
        trees = min(2 * trees, params.maxIter)
    chosen = replace(params, maxIter=best)
    if best < trees:
        model = squared_trees(chosen, target).fit(fit_rows)
        fitted += best
    return Candidate(chosen, clipped_error(model, check, target), fitted)


def search(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    target: str,
    candidates: int = 10,
    patience: int = 100,
    base: TreeParams = TreeParams(maxIter=3000),
    seed: int = 42,
    space: Mapping[str, Sequence[float]] = SEARCH_SPACE,
) -> list[Candidate]:
    """Random search, best candidate first, by mean absolute error of clipped
    forecasts of the validation rows at each candidate's best number of trees."""
    columns = (VECTOR, target)
    spark = with_checkpoint_folder(train.sparkSession)
    with (
        kept(assemble(complete(train, [target]), features).select(*columns)) as fit_rows,
        kept(assemble(complete(validation, [target]), features).select(*columns)) as check,
    ):
        tried = side_by_side(
            spark,
            lambda drawn: staged(fit_rows, check, target, replace(base, **drawn), patience),
            draws(candidates, seed, space),
        )
    return sorted(tried, key=lambda c: (c.mae, astuple(c.params)))


def candidate_table(spark: SparkSession, tried: Sequence[Candidate]) -> DataFrame:
    """One row per candidate, best first by ``place``: settings, error, trees fitted."""
    rows = [
        {"place": i + 1, **{k: float(v) for k, v in asdict(c.params).items()}, "mae": float(c.mae), "fitted": c.fitted}
        for i, c in enumerate(tried)
    ]
    settings = ", ".join(f"{f.name} double" for f in fields(TreeParams))
    return spark.createDataFrame(rows, f"place long, {settings}, mae double, fitted long")


def refit(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    target: str,
    params: TreeParams,
    name: str = "prediction",
    folder: str | None = None,
) -> DataFrame:
    """Fit on all training rows with the chosen settings and forecast the test
    rows. With a shared ``folder`` the model is kept there."""
    models = fit_squared(train, features, [target], params)
    if folder is not None:
        save_models(models, folder)
        models = load_models(folder, [target])
    return with_forecasts(test, models, features, {target: name})
