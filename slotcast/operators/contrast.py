"""Demand on some days against demand on the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.functions.dates import within
from slotcast.operators.levels import (
    BY_SECTOR_AND_CLIENT,
    GROUP,
    KEY,
    OVERALL,
    Levels,
    level_sums,
    mean,
)
from slotcast.operators.profile import HOURS
from slotcast.sources.holidays import holiday_name
from slotcast.sources.weather import rained


def with_holidays(df: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Add ``is_holiday`` and ``holiday_name``: the national holidays, worked out
    from each date, or those of a ``calendar`` (date, holiday_name). Names that a
    calendar has for one date are joined in alphabetical order."""
    if calendar is None:
        named = df.withColumn("holiday_name", holiday_name(F.col("date")))
    else:
        names = F.array_sort(F.collect_set("holiday_name"))
        days = calendar.groupBy("date").agg(F.concat_ws("; ", names).alias("holiday_name"))
        named = df.join(days, "date", "left")
    return named.withColumn("is_holiday", F.col("holiday_name").isNotNull())


def holiday_contrast(
    panel: DataFrame,
    levels: Levels = BY_SECTOR_AND_CLIENT,
    calendar: DataFrame | None = None,
    value: str = "demand",
) -> DataFrame:
    """Mean on each holiday beside the group's mean on all other days.

    The panel is summed by day first; the calendar is joined to that.
    """
    days = with_holidays(level_sums(panel, {"date": F.col("date")}, levels, value), calendar)
    by_name = days.groupBy(*GROUP, "holiday_name").agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("mean")
    )
    group = Window.partitionBy(*GROUP)
    other = F.max(F.when(F.col("holiday_name").isNull(), F.col("mean"))).over(group)
    return (
        by_name.withColumn("other_mean", other)
        .filter(F.col("holiday_name").isNotNull())
        .select("level", "group", "holiday_name", F.col("mean").alias("holiday_mean"), "other_mean")
    )


def with_rain(
    panel: DataFrame, weather: DataFrame, start: str, end: str, mm: float = 1.0
) -> DataFrame:
    """Rows from ``start`` to ``end`` inclusive with ``rained``, null where the
    weather has no row for the day. The weather side is brought to one row per
    day of that span, which bounds what is broadcast."""
    season = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    days = weather.filter(season).groupBy("date").agg(F.max("precip_mm").alias("precip_mm"))
    flags = days.select("date", rained(mm=mm).alias("rained"))
    return panel.filter(season).join(F.broadcast(flags), "date", "left")


def rain_contrast(
    panel: DataFrame,
    weather: DataFrame,
    start: str,
    end: str,
    mm: float = 1.0,
    common_services_only: bool = False,
    value: str = "demand",
) -> DataFrame:
    """Mean by hour with and without rain, from ``start`` to ``end`` inclusive.

    ``common_services_only`` leaves out services seen only on rainy or only on
    dry days. One pass sums the panel by service and hour; which services stay
    is decided on those sums, so the panel is neither read twice nor joined
    with itself.
    """
    days = with_rain(panel, weather, start, end, mm)
    wet, dry = F.col("rained"), ~F.col("rained")
    sums = days.groupBy("service_id", "hour").agg(
        F.sum(F.when(wet, F.col(value))).alias("wet_total"),
        F.count(F.when(wet, F.col(value))).alias("wet_n"),
        F.count(F.when(wet, F.lit(1))).alias("wet_rows"),
        F.sum(F.when(dry, F.col(value))).alias("dry_total"),
        F.count(F.when(dry, F.col(value))).alias("dry_n"),
        F.count(F.when(dry, F.lit(1))).alias("dry_rows"),
    )
    if common_services_only:
        service = Window.partitionBy("service_id")
        sums = (
            sums.filter(F.col("service_id").isNotNull())
            .withColumns({
                "_wet": F.sum("wet_rows").over(service),
                "_dry": F.sum("dry_rows").over(service),
            })
            .filter("_wet > 0 AND _dry > 0")
        )
    by_hour = sums.groupBy(F.col("hour").cast("int").alias("hour")).agg(
        F.try_divide(F.sum("wet_total"), F.sum("wet_n")).alias("rain_mean"),
        F.try_divide(F.sum("dry_total"), F.sum("dry_n")).alias("dry_mean"),
    )
    # 24 rows on the left, at most 25 on the right.
    hours = panel.sparkSession.range(len(HOURS)).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(by_hour), "hour", "left")


def period_contrast(
    panel: DataFrame, start: str, end: str, levels: Levels = OVERALL, value: str = "demand"
) -> DataFrame:
    """Mean inside and outside a closed interval and the difference in percent
    of the outside mean, 0 where that is 0. Rows without a date are outside."""
    inside = within("date", [(start, end)])
    sums = level_sums(panel, {"inside": inside}, levels, value)
    side = {
        name: F.max(F.when(F.col("inside") == flag, mean()))
        for name, flag in (("inside_mean", True), ("outside_mean", False))
    }
    means = sums.groupBy(*GROUP).agg(*[c.alias(name) for name, c in side.items()]).drop(KEY)
    change = (F.col("inside_mean") - F.col("outside_mean")) / F.col("outside_mean") * 100
    return means.withColumn(
        "change_percent", F.when(F.col("outside_mean") == 0, F.lit(0.0)).otherwise(change)
    )
