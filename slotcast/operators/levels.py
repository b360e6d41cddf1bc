"""Sums and means of a panel for several groupings at once.

A level is a name and the columns that make its groups: ``overall`` has none,
``sector`` has the sector. All levels come from one pass: the panel is first
summed by all level columns together (partial sums before the shuffle), and
only that small table goes through the grouping sets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.functions.rows import label

Levels = Mapping[str, Sequence[str]]
OVERALL: Levels = {"overall": ()}
BY_SECTOR_AND_CLIENT: Levels = {"overall": (), "sector": ("sector",), "client": ("client",)}
BY_SECTOR_AND_UNIT: Levels = {"overall": (), "sector": ("sector",), "unit": ("unit",)}
BY_UNIT_AND_SECTOR: Levels = {"unit": ("unit",), "unit_sector": ("unit", "sector")}

ALL = "all"

# What tells groups apart: labels of several columns may be equal, so the
# columns' own values stand beside the label as an array of text.
KEY = "_group"
GROUP = ("level", "group", KEY)


def level_sums(
    df: DataFrame, by: Mapping[str, Column], levels: Levels, value: str = "demand"
) -> DataFrame:
    """(level, group, key, by, total, n): sum and count of the values present.

    Rows whose ``by`` key is null are in no group. A row without a sector is
    missing from the sector groups only.
    """
    columns = sorted({c for cs in levels.values() for c in cs})
    sets = {name: set(cs) for name, cs in levels.items()}
    if len({frozenset(s) for s in sets.values()}) < len(sets):
        raise ValueError("two levels group by the same columns")
    known = df.withColumns(dict(by))
    for key in by:
        known = known.filter(F.col(key).isNotNull())
    finest = known.groupBy(*columns, *by).agg(
        F.sum(value).alias("total"), F.count(value).alias("n")
    )
    grouped = finest.groupingSets(
        [[*s, *by] for s in sets.values()], *columns, *by
    ).agg(
        F.grouping_id().alias("_left_out"),
        F.coalesce(F.sum("total"), F.lit(0.0)).cast("double").alias("total"),
        F.sum("n").alias("n"),
    )
    # The grouping id has a bit, first column highest, for each column left out.
    width = len(columns) + len(by)
    level, group, present = F.lit(None), F.lit(None), F.lit(False)
    key = F.array().cast("array<string>")
    for name, inside in sets.items():
        left_out = sum(1 << (width - 1 - i) for i, c in enumerate(columns) if c not in inside)
        here = F.col("_left_out") == left_out
        level = F.when(here, F.lit(name)).otherwise(level)
        group = F.when(here, label(*levels[name]) if inside else F.lit(ALL)).otherwise(group)
        if inside:
            own = F.array(*[F.col(c).cast("string") for c in levels[name]])
            key = F.when(here, own).otherwise(key)
        known_here = F.lit(True)
        for c in inside:
            known_here = known_here & F.col(c).isNotNull()
        present = F.when(here, known_here).otherwise(present)
    return grouped.filter(present).select(
        level.alias("level"), group.alias("group"), key.alias(KEY), *by, "total", "n"
    )


def mean() -> Column:
    """Mean from ``total`` and ``n``; null where no value is present."""
    return F.try_divide(F.col("total"), F.col("n"))


def level_means(
    df: DataFrame, by: Mapping[str, Column], levels: Levels, value: str = "demand"
) -> DataFrame:
    sums = level_sums(df, by, levels, value)
    return sums.select(*GROUP, *by, mean().alias("mean"))


def group_columns(df: DataFrame) -> list[str]:
    """The columns among ``GROUP`` that a table has."""
    return [c for c in GROUP if c in df.columns]
