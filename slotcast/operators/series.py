"""Daily totals as time series."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.dates import within
from slotcast.grid import SLOT, Grid, fill_grid
from slotcast.operators.joins import in_intervals, merged_intervals
from slotcast.operators.levels import KEY, group_columns

TOTALS = Grid(keys=("level", "group"), hour=None, value="total")


def smoothed(totals: DataFrame, days: int = 7, grid: Grid | None = None) -> DataFrame:
    """Every day from a group's first to its last, null where it has no total,
    with the mean of the totals present in the last ``days`` days. Filling and
    smoothing share one shuffle."""
    grid = grid or replace(TOTALS, keys=tuple(group_columns(totals)))
    dense = fill_grid(totals, grid)
    frame = grid.window().rowsBetween(1 - days, 0)
    return (
        dense.withColumn(SLOT, grid.slot())
        .withColumn("moving_mean", F.avg(grid.value).over(frame))
        .drop(SLOT, KEY)
    )


def interval_means(totals: DataFrame, windows: Iterable[tuple[str, str]]) -> DataFrame:
    """Mean daily total inside and outside a union of closed intervals. Days
    without a total count for neither, so no dense calendar is needed."""
    inside = within("date", windows)
    return totals.groupBy(*group_columns(totals)).agg(
        F.avg(F.when(inside, F.col("total"))).alias("inside_mean"),
        F.avg(F.when(~inside, F.col("total"))).alias("outside_mean"),
    ).drop(KEY)


def interval_means_of(
    totals: DataFrame, windows: DataFrame, on: Sequence[str] = ()
) -> DataFrame:
    """Mean daily total inside and outside the union of the intervals (on, start,
    end) of a table. A day in several intervals counts once; a group without
    intervals has no mean inside."""
    marked = merged_intervals(windows, on).withColumn("_inside", F.lit(True))
    days = in_intervals(totals, marked, on)
    return days.groupBy(*group_columns(totals)).agg(
        F.avg(F.when(F.col("_inside"), F.col("total"))).alias("inside_mean"),
        F.avg(F.when(F.col("_inside").isNull(), F.col("total"))).alias("outside_mean"),
        F.count("_inside").alias("inside_days"),
    ).drop(KEY)
