"""Cut and repair of the raw panel."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.rows import row_mean
from slotcast.grid import HOURLY, SLOT, Grid
from slotcast.operators.joins import dealt_join


def as_of(df: DataFrame, day: str, date: str = "date") -> DataFrame:
    return df.filter(F.col(date) <= F.lit(day).cast("date"))


def repair_spikes(
    df: DataFrame, grid: Grid = HOURLY, factor: float = 2.0, floor: float = 10.0
) -> DataFrame:
    """Replace a value above ``floor`` and above ``factor`` times the mean of
    the same slot one week before and after by that mean. Raw neighbours are
    used, and one pass is made. Rows that share a slot are repaired one by one;
    as a neighbour such a slot counts with the mean of its rows.

    The neighbours are two range frames of one window, so the table is shuffled
    once and joined with nothing.
    """
    week = grid.week
    value = F.col(grid.value).cast("double")
    before, after = grid.at(grid.value, -week), grid.at(grid.value, week)
    near = (
        df.withColumn(SLOT, grid.slot())
        .withColumns({"_before": before, "_after": after})
        .withColumn("_reference", row_mean("_before", "_after"))
    )
    spike = (value > F.lit(factor) * F.col("_reference")) & (value > F.lit(floor))
    repaired = F.when(spike, F.col("_reference")).otherwise(value)
    return near.withColumn(grid.value, repaired).drop(SLOT, "_before", "_after", "_reference")


# Copies that the rows of one slot are dealt over where they meet its reference.
SALTS = 16


def repair_raw_spikes(
    df: DataFrame, grid: Grid = HOURLY, factor: float = 2.0, floor: float = 10.0, salts: int = SALTS
) -> DataFrame:
    """``repair_spikes`` for raw rows, of which a slot and a service can have any number.

    Rows are summed to slots first, with partial sums before the shuffle, so the
    window of a series holds at most one row per slot of the calendar. Only slots
    whose largest value is a spike go back to the raw rows; there the rows of a
    slot, equal ones too, are dealt over ``salts`` copies of its reference, so a
    slot that holds much of the table is not one task.
    """
    value = F.col(grid.value).cast("double")
    mean = replace(grid, value="_mean")
    slots = (
        df.filter(grid.slot().isNotNull()).groupBy(*grid.slot_columns)
        .agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"), F.max(value).alias("_most"))
        .withColumn("_mean", F.try_divide("_sum", "_n"))
        .withColumn(SLOT, grid.slot())
    )
    near = slots.withColumns({
        "_before": mean.at("_mean", -grid.week), "_after": mean.at("_mean", grid.week)
    }).withColumn("_reference", row_mean("_before", "_after"))
    suspect = near.filter(
        (F.col("_most") > F.lit(factor) * F.col("_reference")) & (F.col("_most") > F.lit(floor))
    ).select(*grid.slot_columns, "_reference")
    joined = dealt_join(df, suspect, grid.slot_columns, salts)
    spike = (value > F.lit(factor) * F.col("_reference")) & (value > F.lit(floor))
    repaired = F.when(spike, F.col("_reference")).otherwise(value)
    return joined.withColumn(grid.value, repaired).drop("_reference")
