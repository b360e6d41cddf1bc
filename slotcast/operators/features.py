"""Lags, rolling means and week offsets of a series.

All of them are frames of the one window of ``Grid.window``: partitioned by
series, ordered by slot. Taken together they cost one shuffle and one sort.
Lags and rolling means count rows, so they equal time lags on a gap-free grid
(``fill_grid``); offsets go by the calendar and need no such grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from slotcast.functions.dates import calendar_features
from slotcast.functions.rows import quoted, row_mean, weighted_sum
from slotcast.grid import HOURLY, SLOT, Grid
from slotcast.operators.codes import with_codes

HORIZONS = (1, 2, 3, 4, 5)
BACK = (1, 2, 3, 4)
WIDTHS = (3, 6, 24)

# Names of the inputs.
WEEKLY_LAGS = ["lag_1w", "lag_2w", "lag_3w", "lag_4w"]
DAY_LAGS = ["lag_24h", "lag_48h", "lag_72h"]
ROLLING = [f"roll_mean_{n}h" for n in WIDTHS]
SAME_HOUR = ["same_hour_mean_2w", "same_hour_mean_3w", "same_hour_mean_4w", "same_hour_wavg_4w"]
LAG_FEATURES = [*WEEKLY_LAGS, *DAY_LAGS, *ROLLING, *SAME_HOUR]
CODES = {"service_id": "service_code", "sector": "sector_code"}
# Weights of the last four weeks.
WEEK_WEIGHTS = {"lag_1w": 0.4, "lag_2w": 0.3, "lag_3w": 0.2, "lag_4w": 0.1}


def past(k: int) -> str:
    return f"w_minus_{k}"


def ahead(k: int) -> str:
    return f"w_plus_{k}"


TARGETS = [ahead(h) for h in HORIZONS]


def linear_features(grid: Grid) -> list[str]:
    """The nineteen inputs of the linear models."""
    weeks = [past(k) for k in BACK]
    return [grid.value, *weeks, *DAY_LAGS, *WEEKLY_LAGS, *ROLLING, *SAME_HOUR]


def tree_features(grid: Grid) -> list[str]:
    """The twenty inputs of the weekly-ahead tree models (an hour only where
    the panel has one)."""
    hour = [grid.hour] if grid.hour else []
    return [*CODES.values(), *hour, "weekday", "month", "day", *LAG_FEATURES]


def backtest_features(grid: Grid) -> list[str]:
    """The twenty-five inputs of the year-ahead backtest."""
    extra = ["weekofyear", "dayofyear", "quarter", "weekday_sin", "weekday_cos"]
    return [*tree_features(grid), *extra]


def offset_columns(
    grid: Grid, back: Sequence[int] = BACK, forward: Sequence[int] = HORIZONS
) -> dict[str, Column]:
    """Value of the same slot k weeks before and after, null where there is no
    such row."""
    def at(weeks: int) -> Column:
        return grid.at(grid.value, weeks * grid.week)

    return {**{past(k): at(-k) for k in back}, **{ahead(k): at(k) for k in forward}}


def lag_columns(grid: Grid, value: str, window: WindowSpec | None = None) -> dict[str, Column]:
    """Weekly lags, and lags of one to three days before the one-week lag."""
    window, week = window or grid.window(), grid.week
    weekly = {f"lag_{k}w": F.lag(value, k * week).over(window) for k in BACK}
    daily = {f"lag_{24 * d}h": F.lag(value, week + d * grid.day).over(window) for d in (1, 2, 3)}
    return {**weekly, **daily}


def rolling_columns(grid: Grid, value: str, window: WindowSpec | None = None) -> dict[str, Column]:
    """Means of 3, 6 and 24 rows that end one row before the one-week lag; null
    unless all of them are there."""
    columns = {}
    for n in WIDTHS:
        frame = (window or grid.window()).rowsBetween(-(grid.week + n), -(grid.week + 1))
        full = F.count(value).over(frame) == n
        columns[f"roll_mean_{n}h"] = F.when(full, F.avg(value).over(frame))
    return columns


def same_hour_columns() -> dict[str, Column]:
    """Means over the last 2, 3 and 4 weeks, and the weighted one."""
    means = {f"same_hour_mean_{k}w": row_mean(*WEEKLY_LAGS[:k]) for k in (2, 3, 4)}
    return {**means, "same_hour_wavg_4w": weighted_sum(WEEK_WEIGHTS)}


def with_offsets(
    df: DataFrame,
    grid: Grid = HOURLY,
    back: Sequence[int] = BACK,
    forward: Sequence[int] = HORIZONS,
) -> DataFrame:
    slotted = df.withColumn(SLOT, grid.slot())
    return slotted.withColumns(offset_columns(grid, back, forward)).drop(SLOT)


def with_lags(df: DataFrame, grid: Grid = HOURLY) -> DataFrame:
    """Lags, rolling means and same-hour means of each series."""
    return _with_frames(df, grid, {})


def with_features(df: DataFrame, grid: Grid = HOURLY) -> DataFrame:
    """Offsets and all series features from one shuffle."""
    return _with_frames(df, grid, offset_columns(grid))


def _with_frames(df: DataFrame, grid: Grid, offsets: dict[str, Column]) -> DataFrame:
    # Rows without a complete key are no series: their values take no part in
    # lags, though offsets match them like any other key.
    keyed = F.expr(" AND ".join(f"{quoted(k)} IS NOT NULL" for k in grid.keys))
    slotted = df.withColumns({SLOT: grid.slot(), "_keyed": F.when(keyed, F.col(grid.value))})
    lags = {**lag_columns(grid, "_keyed"), **rolling_columns(grid, "_keyed")}
    wide = slotted.withColumns({**offsets, **lags})
    return wide.drop(SLOT, "_keyed").withColumns(same_hour_columns())


def with_calendar(df: DataFrame, grid: Grid = HOURLY) -> DataFrame:
    return df.withColumns(calendar_features(grid.date))


def with_model_features(df: DataFrame, grid: Grid = HOURLY) -> DataFrame:
    """Series features, calendar features and category codes."""
    return with_calendar(with_features(with_codes(df, CODES), grid), grid)


def without_implied(columns: Sequence[str]) -> list[str]:
    """Leave out the same-hour means, which are known where the weekly lags are."""
    implied = SAME_HOUR if set(WEEKLY_LAGS) <= set(columns) else []
    return [c for c in columns if c not in implied]


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows on which all the columns are known. One condition per column, since
    only such conditions reach a Parquet scan and stay cheap to plan with."""
    needed = without_implied(columns)
    return df.filter(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in needed))
