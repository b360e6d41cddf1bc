"""Backtests: forecast a later span of a panel and tabulate the errors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from slotcast.functions.checkpoints import checkpointed
from slotcast.grid import HOURLY, Grid
from slotcast.operators.backtest import (
    Span,
    around,
    compare,
    errors,
    in_span,
    score,
    split,
    with_recursive_mean,
    with_same_hour_mean,
)
from slotcast.operators.codes import with_codes
from slotcast.operators.features import (
    CODES,
    HORIZONS,
    TARGETS,
    WEEKLY_LAGS,
    ahead,
    backtest_features,
    complete,
    linear_features,
    past,
    tree_features,
    with_calendar,
    with_features,
    with_lags,
    with_model_features,
    with_offsets,
    without_implied,
)
from slotcast.operators.linear import fit, keep_scored, predict
from slotcast.operators.trees import (
    SQUARED,
    Candidate,
    TreeParams,
    forecast_counts,
    forecast_squared,
    refit,
    search,
)

OFFSETS = [past(1), past(2), *TARGETS]


@dataclass(frozen=True)
class Spans:
    """Half-open spans of a backtest; ``embargo_days`` of 35 keeps training
    targets out of the test span."""

    train: Span = ("2021-01-01", "2025-01-01")
    test: Span = ("2025-01-01", "2026-01-01")
    embargo_days: int = 0


# The published spans.
DEFAULT = Spans()
EARLY_CUT = Spans(train=("2021-01-01", "2024-07-01"))


def recursive_mean_backtest(panel: DataFrame, test: Span, grid: Grid = HOURLY) -> DataFrame:
    """Errors of the recursive mean. It looks back by the calendar only, so only
    rows around the test span are needed; where ``panel`` is a table, and not
    the result of filling gaps, no others are read."""
    near = with_offsets(around(panel, test, grid.date, 14, 35), grid, back=(1, 2))
    known = complete(in_span(near, test, grid.date), OFFSETS)
    return score(with_recursive_mean(known, grid), ["baseline"])


def same_hour_backtest(panel: DataFrame, test: Span, grid: Grid = HOURLY) -> DataFrame:
    """Errors of the three-week mean at the same hour."""
    rows = complete(with_features(panel, grid), [*linear_features(grid), *TARGETS])
    return score(with_same_hour_mean(in_span(rows, test, grid.date)), ["baseline"])


def linear_rows(panel: DataFrame, spans: Spans, grid: Grid = HOURLY) -> tuple[DataFrame, ...]:
    """Training and test rows with all nineteen inputs and five targets. Both
    come from one table with the same conditions, so its shuffle is reused."""
    rows = complete(with_features(panel, grid), [*grid.keys, *linear_features(grid), *TARGETS])
    return split(rows, spans.train, spans.test, date=grid.date, embargo_days=spans.embargo_days)


def linear_models(
    panel: DataFrame,
    spans: Spans = DEFAULT,
    grid: Grid = HOURLY,
    by_series: bool = False,
    intercept: bool = False,
) -> DataFrame:
    """Weights of the shared model, or of each series that has rows to forecast."""
    keys = list(grid.keys) if by_series else []
    train, test = linear_rows(panel, spans, grid)
    models = fit(train, linear_features(grid), TARGETS, keys, intercept)
    return keep_scored(models, test, keys) if keys else models


def linear_forecast(
    panel: DataFrame,
    spans: Spans = DEFAULT,
    grid: Grid = HOURLY,
    by_series: bool = False,
    intercept: bool = False,
) -> DataFrame:
    """Test rows with the linear forecasts and the three-week mean."""
    keys = list(grid.keys) if by_series else []
    train, test = linear_rows(panel, spans, grid)
    features = linear_features(grid)
    models = fit(train, features, TARGETS, keys, intercept)
    return with_same_hour_mean(predict(test, models, features, HORIZONS, keys, "linear"))


def linear_benchmark(
    panel: DataFrame,
    spans: Spans = DEFAULT,
    grid: Grid = HOURLY,
    by_series: bool = False,
    intercept: bool = False,
) -> DataFrame:
    """Errors per horizon of the three-week mean and of least squares."""
    forecast = linear_forecast(panel, spans, grid, by_series, intercept)
    return compare(score(forecast, ["baseline", "linear"]), "baseline", ["linear"])


def tree_benchmark(
    panel: DataFrame,
    spans: Spans = DEFAULT,
    grid: Grid = HOURLY,
    params: TreeParams = SQUARED,
    horizons: Sequence[int] = HORIZONS,
    folder: str | None = None,
) -> DataFrame:
    """Errors per horizon of the three-week mean and of squared-error trees. With
    a shared ``folder`` the models are kept there."""
    train, test = linear_rows(panel, spans, grid)
    forecast = forecast_squared(train, test, linear_features(grid), params, horizons, folder=folder)
    scores = score(with_same_hour_mean(forecast), ["baseline", "trees"], horizons)
    return compare(scores, "baseline", ["trees"])


def tree_rows(
    panel: DataFrame, spans: Spans, grid: Grid = HOURLY, drop_before_lag: bool = False
) -> tuple[DataFrame, ...]:
    """Rows with the tree inputs, the recursive mean and the targets. With
    ``drop_before_lag`` rows without all offsets are left out before lags
    count rows, as some published comparisons do. They are worked out once, into a
    checkpoint that the spans, models and scores of a comparison read."""
    if drop_before_lag:
        known = complete(with_offsets(panel, grid), OFFSETS)
        rows = with_calendar(with_lags(with_codes(known, CODES), grid), grid)
    else:
        rows = complete(with_model_features(panel, grid), OFFSETS)
    needed = [*grid.keys, *tree_features(grid), *TARGETS]
    rows = checkpointed(complete(with_recursive_mean(rows, grid), needed))
    return split(rows, spans.train, spans.test, date=grid.date, embargo_days=spans.embargo_days)


def count_features(grid: Grid) -> list[str]:
    """Inputs of the count models, without those that follow from others."""
    return without_implied(tree_features(grid))


def count_benchmark(
    panel: DataFrame,
    spans: Spans = DEFAULT,
    grid: Grid = HOURLY,
    horizons: Sequence[int] = HORIZONS,
    drop_before_lag: bool = True,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Errors per horizon of the recursive mean and of Poisson regression."""
    train, test = tree_rows(panel, spans, grid, drop_before_lag)
    forecast = forecast_counts(train, test, features or count_features(grid), horizons)
    return compare(score(forecast, ["baseline", "counts"], horizons), "baseline", ["counts"])


def with_three_forecasts(
    train: DataFrame,
    test: DataFrame,
    grid: Grid = HOURLY,
    horizons: Sequence[int] = HORIZONS,
    features: Sequence[str] | None = None,
    trees: TreeParams | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Test rows of ``tree_rows`` with least squares on the last four weeks and
    Poisson regression beside the recursive mean; with ``trees`` also squared-error
    trees on all inputs, kept in ``folder``."""
    models = fit(train, WEEKLY_LAGS, [ahead(h) for h in horizons])
    linear = predict(test, models, WEEKLY_LAGS, horizons, method="linear")
    counts = forecast_counts(train, linear, features or count_features(grid), horizons)
    if trees is None:
        return counts
    return forecast_squared(train, counts, tree_features(grid), trees, horizons, folder=folder)


def three_way_benchmark(
    panel: DataFrame,
    spans: Spans = EARLY_CUT,
    grid: Grid = HOURLY,
    horizons: Sequence[int] = HORIZONS,
    drop_before_lag: bool = True,
    features: Sequence[str] | None = None,
    trees: TreeParams | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Errors per horizon of the three forecasts, and of trees where asked for."""
    train, test = tree_rows(panel, spans, grid, drop_before_lag)
    forecast = with_three_forecasts(train, test, grid, horizons, features, trees, folder)
    methods = ["baseline", "linear", "counts", *(["trees"] if trees is not None else [])]
    return compare(score(forecast, methods, horizons), "baseline", methods[1:])


def year_backtest(
    panel: DataFrame,
    train: Span = ("2021-01-01", "2024-01-01"),
    validation: Span = ("2024-01-01", "2025-01-01"),
    test: Span = ("2025-01-01", "2026-01-01"),
    grid: Grid = HOURLY,
    candidates: int = 10,
    patience: int = 100,
    base: TreeParams = TreeParams(maxIter=3000),
    folder: str | None = None,
) -> tuple[list[Candidate], DataFrame]:
    """Search settings on the validation span, refit on both earlier spans, and
    give the errors of the test span beside the candidates tried. With a shared
    ``folder`` the refitted model is kept there. The panel and its inputs are
    worked out once."""
    features = backtest_features(grid)
    rows = with_model_features(checkpointed(panel), grid)
    rows = checkpointed(complete(rows, [*features, grid.value]))
    fit_rows, check, held = split(rows, train, validation, test, date=grid.date)
    tried = search(fit_rows, check, features, grid.value, candidates, patience, base)
    whole = in_span(rows, (train[0], validation[1]), grid.date)
    scored = refit(whole, held, features, grid.value, tried[0].params, folder=folder)
    figures = errors(scored[grid.value], scored["prediction"])
    return tried, scored.agg(*[c.alias(name) for name, c in figures.items()])
