"""Registered queries that score the counts model on test rows; SQL cannot fit it."""

import numpy as np
import pytest

from queries import QUERIES
from queries.forecasts import COUNT_INPUTS, EARLY
from queries.panels import daily_dense
from slotcast.grid import DAILY
from slotcast.operators import backtest, features
from slotcast.plans import benchmarks
from tests.test_oracle import SF


def by_horizon(frame):
    found = {r["horizon"]: r.asDict() for r in frame.collect()}
    assert sorted(found) == list(features.HORIZONS)
    return found


def same(row, method, want):
    assert row[f"mae_{method}"] == pytest.approx(want[0], abs=2e-4)
    assert row[f"mse_{method}"] == pytest.approx(want[1], rel=1e-4, abs=2e-4)


def newton(x, y):
    """Weights of highest Poisson likelihood with a logarithmic link."""
    w = np.zeros(x.shape[1])
    w[0] = np.log(y.mean())
    for _ in range(100):
        mean = np.exp(x @ w)
        step = np.linalg.solve(x.T @ (x * mean[:, None]), x.T @ (y - mean))
        w += step
        if np.abs(step).max() < 1e-11:
            return w
    raise AssertionError("no convergence")


def test_counts_and_three_way_on_test_rows(spark):
    """Both models are fitted anew in numpy, from the rows alone."""
    panel = daily_dense(spark, SF)
    counts, three = by_horizon(QUERIES["poisson_errors"](spark, SF)), by_horizon(QUERIES["three_way_errors"](spark, SF))
    train, test = (part.toPandas() for part in benchmarks.tree_rows(panel, EARLY, DAILY, True))
    assert test["date"].min() > train["date"].max()
    inputs = [np.column_stack([np.ones(len(p)), p[COUNT_INPUTS].to_numpy(float)]) for p in (train, test)]
    lags = [p[features.WEEKLY_LAGS].to_numpy(float) for p in (train, test)]
    for h in features.HORIZONS:
        known, truth = (p[features.ahead(h)].to_numpy(float) for p in (train, test))
        guesses = {
            "counts": np.exp(inputs[1] @ newton(inputs[0], known)),
            "linear": np.maximum(0, lags[1] @ np.linalg.lstsq(lags[0], known, rcond=None)[0]),
            "baseline": test[backtest.predicted(h, "baseline")].to_numpy(float),
        }
        for method, guess in guesses.items():
            want = np.abs(truth - guess).mean(), ((truth - guess) ** 2).mean()
            same(three[h], method, want)
            if method != "linear":
                same(counts[h], method, want)
