"""Shape of a panel: which columns name a series, its calendar slot and its value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLOT = "_slot"


@dataclass(frozen=True)
class Grid:
    """A panel has at most one row per series and slot.

    That is what bounds a series window: a series can never hold more rows than
    the calendar has slots, however large the whole panel is. ``consolidate``
    makes it true of raw rows, ``duplicate_slots`` checks it.
    """

    keys: tuple[str, ...] = ("service_id", "sector")
    date: str = "date"
    hour: str | None = "hour"
    value: str = "demand"

    @property
    def day(self) -> int:
        return 24 if self.hour else 1

    @property
    def week(self) -> int:
        return 7 * self.day

    @property
    def slot_columns(self) -> tuple[str, ...]:
        return (*self.keys, self.date, *((self.hour,) if self.hour else ()))

    def slot(self) -> Column:
        """Position on the calendar as one whole number, so that day, hour and
        week distances are plain differences and every window can share an order."""
        days = F.unix_date(self.date).cast("long")
        return days * 24 + F.col(self.hour) if self.hour else days

    def window(self) -> WindowSpec:
        """The one window spec of the library; needs the ``SLOT`` column."""
        return Window.partitionBy(*self.keys).orderBy(F.col(SLOT).asc_nulls_last())

    def at(self, column: str, steps: int) -> Column:
        """Value of the slot ``steps`` away, the mean where it has several rows;
        null where there is none and for rows that have no slot themselves."""
        near = F.avg(column).over(self.window().rangeBetween(steps, steps))
        return F.when(F.col(SLOT).isNotNull(), near)


HOURLY = Grid()
DAILY = Grid(hour=None)


def consolidate(df: DataFrame, grid: Grid = HOURLY) -> DataFrame:
    """Sum raw rows to one row per slot. Partial sums are taken before the
    shuffle, so a hot service costs no more there than any other."""
    return df.groupBy(*grid.slot_columns).agg(F.sum(grid.value).alias(grid.value))


def duplicate_slots(df: DataFrame, grid: Grid = HOURLY) -> DataFrame:
    """Slots that occur more than once; empty for a valid panel."""
    return (
        df.groupBy(*grid.slot_columns)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
    )


# Longest gap that is filled, in years: a longer one is taken for a mistyped date.
LONGEST_GAP = 50


def fill_grid(
    df: DataFrame, grid: Grid = HOURLY, fill: float | None = None, longest_gap: int = LONGEST_GAP
) -> DataFrame:
    """Give every series all slots between its own first and last one.

    Each row is repeated up to the slot before its successor, so there is no
    spine table and no join, and what follows in the same series window needs
    no second shuffle. New slots carry ``fill``; other columns of the panel
    than keys, slot and value are not kept. Rows without a slot are left out; a
    gap of more than ``longest_gap`` years ends the job.
    """
    following = F.lead(SLOT).over(grid.window())
    gap = F.col("_until") - F.col(SLOT)
    mistyped = F.concat(F.lit("gap too long to fill, in slots: "), gap.cast("string"))
    filled = (
        df.select(*grid.keys, grid.slot().alias(SLOT), F.col(grid.value).alias("_value"))
        .withColumn("_until", F.coalesce(following - 1, F.col(SLOT)))
        .withColumn(
            "_until",
            F.when(gap > longest_gap * 366 * grid.day, F.raise_error(mistyped).cast("long"))
            .otherwise(F.col("_until")),
        )
        .withColumn("_at", F.explode(F.sequence(SLOT, "_until")))
    )
    hour = F.pmod(F.col("_at"), F.lit(24))
    day = (F.col("_at") - hour) / 24 if grid.hour else F.col("_at")
    value = F.when(F.col("_at") == F.col(SLOT), F.col("_value"))
    value = value.otherwise(F.lit(fill).cast("double"))
    columns = [*grid.keys, F.date_from_unix_date(day.cast("int")).alias(grid.date)]
    if grid.hour:
        columns.append(hour.cast("int").alias(grid.hour))
    return filled.select(*columns, value.alias(grid.value))


def missing_slots(df: DataFrame, grid: Grid = HOURLY) -> DataFrame:
    """How many slots each series lacks; row-counting lags equal time lags where 0."""
    return (
        df.select(*grid.keys, grid.slot().alias(SLOT))
        .groupBy(*grid.keys)
        .agg((F.max(SLOT) - F.min(SLOT) + 1 - F.count(SLOT)).alias("missing"))
    )
