"""Least squares for all horizons at once, shared or per series.

The sums of products of a least-squares fit are plain aggregates. Taking them
for all horizons together needs one pass over the training rows, partial sums
before the shuffle, and leaves one row of fixed size per series. So no series
is ever gathered in a task, however long it is, and the shared model is the
same job without keys. Only solving those small systems is done in Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotcast.functions.rows import dot, not_negative, quoted
from slotcast.operators.backtest import Span, predicted
from slotcast.operators.features import TARGETS, complete

# Directions this much weaker than the strongest one count as linear dependence.
TOLERANCE = 1e-10


def moments(
    train: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, moments): the matrix of sums of products, whose lines are 1 and
    the features and whose columns are 1, the features and the targets.

    A training row is unfolded into one row per line of the matrix, so that the
    aggregate has few columns and stays in generated code; one aggregate with a
    column per product runs some ten times slower.
    """
    # Columns keep their names here: each new alias would double the filters
    # that the planner infers from those on the training rows.
    columns = ["1D", *[f"double({quoted(c)})" for c in (*features, *targets)]]
    lines = [f"struct({i} AS _line, {c} AS _z)" for i, c in enumerate(columns[: len(features) + 1])]
    unfolded = F.expr(f"inline(array({', '.join(lines)}))")
    known = complete(train, [*keys, *features, *targets])
    sums = (
        known.select(*keys, *features, *targets, unfolded)
        .groupBy(*keys, "_line")
        .agg(F.expr(f"array({', '.join(f'sum(_z * {c})' for c in columns)})").alias("sums"))
    )
    matrix = F.expr("array_sort(collect_list(struct(_line, sums))).sums")
    return sums.groupBy(*keys).agg(matrix.alias("moments"))


def solver(keys: Sequence[str], n: int, intercept: bool):
    """The function that solves a batch of moment matrices. It refers to nothing
    outside itself, so workers need numpy and pandas only."""
    tolerance = TOLERANCE

    def solve(matrix) -> tuple[int, list, list]:
        whole = np.array([np.asarray(line, dtype=float) for line in matrix])
        rows, x, y = whole[0, 0], whole[0, 1 : n + 1], whole[0, n + 1 :]
        gram, cross = whole[1:, 1 : n + 1], whole[1:, n + 1 :]
        size = np.abs(gram).max(initial=0.0)
        if intercept:
            gram = gram - np.outer(x, x) / rows
            cross = cross - np.outer(x, y) / rows
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        # Centring leaves rounding of the size of the raw sums.
        kept = values > max(tolerance * values[-1], 1e-13 * size)
        inverse = np.where(kept, 1.0 / np.where(kept, values, 1.0), 0.0)
        weights = (vectors * inverse) @ (vectors.T @ cross)
        offsets = (y - x @ weights) / rows if intercept else np.zeros(len(y))
        return int(rows), weights.T.tolist(), offsets.tolist()

    def solve_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keys)].copy()
            solved = [solve(matrix) for matrix in batch["moments"]]
            out["rows"] = [rows for rows, _, _ in solved]
            out["weights"] = [weights for _, weights, _ in solved]
            out["intercepts"] = [offsets for _, _, offsets in solved]
            yield out

    return solve_batches


def fit(
    train: DataFrame,
    features: Sequence[str],
    targets: Sequence[str] = TARGETS,
    keys: Sequence[str] = (),
    intercept: bool = False,
) -> DataFrame:
    """(keys, rows, weights, intercepts): per key one array of weights and one
    intercept for each target. Of all weights that fit best, those of smallest
    norm are taken. No training rows, no row."""
    return _solved(moments(train, features, targets, keys), features, keys, intercept)


def _solved(sums: DataFrame, features: Sequence[str], keys: Sequence[str], intercept: bool) -> DataFrame:
    sums = sums.filter(F.size("moments") > 0)
    weights = T.ArrayType(T.ArrayType(T.DoubleType()))
    schema = T.StructType([
        *[sums.schema[k] for k in keys],
        T.StructField("rows", T.LongType()),
        T.StructField("weights", weights),
        T.StructField("intercepts", T.ArrayType(T.DoubleType())),
    ])
    return sums.mapInPandas(solver(keys, len(features), intercept), schema)


def fit_spans(
    rows: DataFrame,
    spans: Mapping[str, Span],
    features: Sequence[str],
    targets: Sequence[str] = TARGETS,
    keys: Sequence[str] = (),
    intercept: bool = False,
    date: str = "date",
) -> DataFrame:
    """(span, keys, rows, weights, intercepts): ``fit`` for several training spans
    from one pass over ``rows``.

    The first and last days of all spans cut the calendar into periods. Sums of
    products are taken by period, and as they add up, the sums of a span are those
    of its periods: small matrices, added and never subtracted, so a short span
    loses nothing beside a long one.
    """
    edges = sorted({day for span in spans.values() for day in span if day is not None})
    period = sum((F.when(F.col(date) >= F.lit(day).cast("date"), 1).otherwise(0) for day in edges), F.lit(0))
    reach = [
        (name, edges.index(lo) + 1 if lo else 0, edges.index(hi) if hi else len(edges))
        for name, (lo, hi) in spans.items()
    ]
    inside = reduce(or_, [F.col("_period").between(lo, hi) for _, lo, hi in reach])
    dated = rows.filter(F.col(date).isNotNull()).withColumn("_period", period).filter(inside)
    sums = moments(dated, features, targets, [*keys, "_period"])
    names = F.array_compact(F.array(*[F.when(F.col("_period").between(lo, hi), F.lit(name)) for name, lo, hi in reach]))
    lines = sums.select(F.explode(names).alias("span"), *keys, F.posexplode("moments").alias("_line", "_sums"))
    total = F.array(*[F.sum(F.col("_sums")[i]) for i in range(1 + len(features) + len(targets))])
    whole = (
        lines.groupBy("span", *keys, "_line").agg(total.alias("_sums")).groupBy("span", *keys)
        .agg(F.expr("array_sort(collect_list(struct(_line, _sums)))._sums").alias("moments"))
    )
    return _solved(whole, features, ["span", *keys], intercept)


def predict(
    df: DataFrame,
    models: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int],
    keys: Sequence[str] = (),
    method: str = "linear",
) -> DataFrame:
    """Add a forecast, not below 0, for each horizon. With keys, rows of a
    series that has no model get null."""
    names = [predicted(h, method) for h in horizons]
    model = models.select(*keys, F.struct("weights", "intercepts").alias("_model"))
    if keys:
        joined = df.join(model, list(keys), "left")
    else:
        # At most one row of fixed size. As a subquery it runs within the same
        # job, so the training rows can share a shuffle with the rows forecast.
        joined = df.withColumn("_model", model.scalar())
    inputs = F.array(*[F.col(f).cast("double") for f in features])
    forecasts = {
        name: not_negative(
            dot(f"_model.weights[{i}]", "_inputs") + F.expr(f"_model.intercepts[{i}]")
        )
        for i, name in enumerate(names)
    }
    return joined.withColumn("_inputs", inputs).withColumns(forecasts).drop("_model", "_inputs")


def keep_scored(models: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Models of series that have rows to forecast."""
    scored = test.select(*keys).distinct()
    return models.join(scored, list(keys), "left_semi")


def weight_table(
    models: DataFrame,
    features: Sequence[str],
    targets: Sequence[str] = TARGETS,
    keys: Sequence[str] = (),
    intercept: bool = False,
) -> DataFrame:
    """(keys, horizon, feature, weight), one row per weight; with ``intercept``
    also one per intercept, under that name."""
    name = F.array(*[F.lit(f) for f in features])
    target = F.array(*[F.lit(t) for t in targets])
    weights = F.col("weights")
    if intercept:
        weights = F.zip_with("weights", "intercepts", lambda w, i: F.concat(w, F.array(i)))
        name = F.array(*[F.lit(f) for f in (*features, "intercept")])
    by_target = models.select(*keys, F.posexplode(weights).alias("_t", "_w"))
    by_feature = by_target.select(*keys, "_t", F.posexplode("_w").alias("_f", "weight"))
    return by_feature.select(
        *keys, F.get(target, F.col("_t")).alias("horizon"),
        F.get(name, F.col("_f")).alias("feature"), "weight",
    )
