"""Frames over rows of series that are too long for one task.

A series is cut in two steps. Its rows are numbered in order of slot: each is
ranked within its stretch of the calendar, and the counts of the stretches before
it, which are few, are added. Then rows are dealt to chunks of equal numbers of
rows; a row goes to its own chunk and to the later ones that look back on it. A
frame that reaches at most ``back`` rows back is whole within a chunk, so lags
still count rows, whatever gaps the calendar has. A chunk never holds more than
``rows + back`` rows, however long its series is.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from slotcast.functions.rows import quoted
from slotcast.grid import HOURLY, SLOT, Grid
from slotcast.operators.features import (
    BACK,
    WIDTHS,
    lag_columns,
    rolling_columns,
    same_hour_columns,
)
from slotcast.operators.joins import dealt_join

PLACE, CHUNK = "_place", "_chunk"
# Stretches that rows without a slot, which stand last, are dealt over.
UNDATED = 64
_LATE = 1 << 40


def placed(df: DataFrame, grid: Grid = HOURLY, stretch: int | None = None) -> DataFrame:
    """``df`` with ``SLOT`` and ``PLACE``, the number of each row in its series, from 0.

    ``stretch`` is the number of slots that are ranked together. Rows of one slot
    stand in order of value, rows without a slot last.
    """
    stretch = stretch or 4 * grid.week
    undated = F.lit(_LATE) + F.pmod(F.xxhash64(grid.value), F.lit(UNDATED))
    slotted = df.withColumn(SLOT, grid.slot()).withColumn(
        "_stretch", F.coalesce(F.floor(F.col(SLOT) / stretch), undated)
    )
    cut = [*grid.keys, "_stretch"]
    inside = Window.partitionBy(*cut).orderBy(SLOT, grid.value)
    before = Window.partitionBy(*grid.keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    skip = F.coalesce(F.sum("_n").over(before), F.lit(0))
    counts = slotted.groupBy(*cut).agg(F.count(F.lit(1)).alias("_n")).withColumn("_skip", skip).drop("_n")
    ranked = slotted.withColumn("_rank", F.row_number().over(inside) - 1)
    return dealt_join(ranked, counts, cut).withColumn(PLACE, F.col("_rank") + F.col("_skip")).drop(
        "_rank", "_skip", "_stretch"
    )


def chunk_window(grid: Grid) -> WindowSpec:
    return Window.partitionBy(*grid.keys, CHUNK).orderBy(PLACE)


def over_chunks(
    rows: DataFrame, columns: Callable[[WindowSpec], Mapping[str, Column]], back: int, size: int | None = None,
    grid: Grid = HOURLY,
) -> DataFrame:
    """``rows`` of ``placed`` with the window columns that ``columns`` makes, whose
    frames reach no more than ``back`` rows back and none ahead."""
    size = size or 8 * back
    chunk = lambda place: F.floor(place / size).cast("long")
    own = chunk(F.col(PLACE))
    dealt = rows.withColumn(CHUNK, F.explode(F.sequence(own, chunk(F.col(PLACE) + back))))
    wide = dealt.withColumns(dict(columns(chunk_window(grid))))
    return wide.filter(F.col(CHUNK) == own).drop(CHUNK)


def with_lags_in_chunks(df: DataFrame, grid: Grid = HOURLY, size: int | None = None) -> DataFrame:
    """``features.with_lags`` for few, very long series: the same columns, each
    series spread over chunks of ``size`` rows."""
    keyed = F.expr(" AND ".join(f"{quoted(k)} IS NOT NULL" for k in grid.keys))
    rows = placed(df, grid).withColumn("_keyed", F.when(keyed, F.col(grid.value)))
    back = max(max(BACK) * grid.week, grid.week + max(*WIDTHS, 3 * grid.day))

    def columns(window: WindowSpec) -> dict[str, Column]:
        return {**lag_columns(grid, "_keyed", window), **rolling_columns(grid, "_keyed", window)}

    wide = over_chunks(rows, columns, back, size, grid)
    return wide.drop(SLOT, PLACE, "_keyed").withColumns(same_hour_columns())


def moving_mean_in_chunks(
    df: DataFrame, days: int = 7, grid: Grid = HOURLY, size: int | None = None, name: str = "moving_mean"
) -> DataFrame:
    """``df`` with the mean of the values present in the last ``days`` rows of each series."""
    def columns(window: WindowSpec) -> dict[str, Column]:
        return {name: F.avg(grid.value).over(window.rowsBetween(1 - days, 0))}

    return over_chunks(placed(df, grid), columns, days - 1, size or 512 * days, grid).drop(SLOT, PLACE)
