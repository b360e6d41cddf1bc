"""Mean demand over a calendar dimension, with its peak and reference line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.functions.dates import BUSINESS_DAY, MONTHS, WEEKDAYS, WEEKEND, day_type, name_at
from slotcast.operators.levels import (
    BY_SECTOR_AND_CLIENT,
    BY_SECTOR_AND_UNIT,
    BY_UNIT_AND_SECTOR,
    GROUP,
    KEY,
    OVERALL,
    Levels,
    level_means,
    level_sums,
    mean,
)

HOURS = range(24)


def completed(means: DataFrame, position: str, domain: Sequence[int]) -> DataFrame:
    """Give every group the whole domain in its order, with null where it has
    no value, and add the group's peak and its mean of means.

    The domain is a short fixed list, so a group is folded into one map and
    unfolded again: one shuffle, and no join with a spine.
    """
    inside = means.filter(F.col(position).between(min(domain), max(domain)))
    folded = inside.groupBy(*GROUP).agg(
        F.map_from_entries(F.collect_list(F.struct(position, "mean"))).alias("_means"),
        *peak_columns(position),
    )
    spine = F.explode(F.array(*[F.lit(d) for d in domain]))
    return folded.select(
        "level", "group", spine.alias(position), "_means",
        "reference_mean", f"peak_{position}", "peak_mean",
    ).select(
        "level", "group", position,
        F.try_element_at("_means", F.col(position)).alias("mean"),
        "reference_mean", f"peak_{position}", "peak_mean",
    )


def peak_columns(position: str) -> list[Column]:
    """Mean of the means present, and the first position of the highest."""
    height = F.struct(F.col("mean"), -F.col(position))
    return [
        F.avg("mean").alias("reference_mean"),
        F.max_by(position, F.when(F.col("mean").isNotNull(), height)).alias(f"peak_{position}"),
        F.max("mean").alias("peak_mean"),
    ]


def hour_profile(
    panel: DataFrame, levels: Levels = BY_SECTOR_AND_CLIENT, value: str = "demand"
) -> DataFrame:
    means = level_means(panel, {"hour": F.col("hour").cast("int")}, levels, value)
    return completed(means, "hour", HOURS)


def unit_sector_hours(panel: DataFrame, value: str = "demand") -> DataFrame:
    """Hours of each unit, and of each sector within its unit."""
    return hour_profile(panel, BY_UNIT_AND_SECTOR, value)


def weekday_profile(
    panel: DataFrame, levels: Levels = BY_SECTOR_AND_CLIENT, value: str = "demand"
) -> DataFrame:
    means = level_means(panel, {"weekday": F.weekday("date")}, levels, value)
    profile = completed(means, "weekday", range(7))
    return profile.withColumns({
        "weekday_name": name_at(WEEKDAYS, F.col("weekday")),
        "peak_name": name_at(WEEKDAYS, F.col("peak_weekday")),
    })


def month_profile(
    panel: DataFrame, levels: Levels = BY_SECTOR_AND_CLIENT, value: str = "demand"
) -> DataFrame:
    means = level_means(panel, {"month": F.month("date")}, levels, value)
    profile = completed(means, "month", range(1, 13))
    return profile.withColumn("month_name", name_at(MONTHS, F.col("month") - 1))


def year_profile(
    panel: DataFrame, levels: Levels = BY_SECTOR_AND_UNIT, value: str = "demand"
) -> DataFrame:
    """Only years that occur; the reference line is the mean of their means."""
    means = level_means(panel, {"year": F.year("date")}, levels, value)
    group = Window.partitionBy(*GROUP)
    return means.withColumn("reference_mean", F.avg("mean").over(group)).drop(KEY)


def weekday_hour_matrix(
    panel: DataFrame, levels: Levels = BY_SECTOR_AND_CLIENT, value: str = "demand"
) -> DataFrame:
    """One row per group and weekday, one column per hour. Each group gets its
    own matrix."""
    by = {"weekday": F.weekday("date"), "hour": F.col("hour").cast("int")}
    means = level_means(panel, by, levels, value)
    hours = {f"h{h:02d}": F.max(F.when(F.col("hour") == h, F.col("mean"))) for h in HOURS}
    by_weekday = means.groupBy(*GROUP, "weekday").agg(
        *[c.alias(name) for name, c in hours.items()]
    )
    row = F.struct(*hours)
    folded = by_weekday.groupBy(*GROUP).agg(
        F.map_from_entries(F.collect_list(F.struct("weekday", row.alias("row")))).alias("_rows")
    )
    spine = F.explode(F.array(*[F.lit(d) for d in range(7)]))
    unfolded = folded.select("level", "group", spine.alias("weekday"), "_rows").withColumn(
        "_row", F.try_element_at("_rows", F.col("weekday"))
    )
    return unfolded.select(
        "level", "group", "weekday", name_at(WEEKDAYS, F.col("weekday")).alias("weekday_name"),
        *[F.col("_row").getField(name).alias(name) for name in hours],
    )


def day_type_profile(
    panel: DataFrame, levels: Levels = OVERALL, value: str = "demand"
) -> DataFrame:
    """Business days against weekends, ordered by ``position``."""
    sums = level_sums(panel, {"day_type": day_type("date")}, levels, value)
    position = F.array_position(F.array(F.lit(BUSINESS_DAY), F.lit(WEEKEND)), F.col("day_type"))
    return sums.select(
        "level", "group", position.cast("int").alias("position"), "day_type", mean().alias("mean")
    ).orderBy("level", "group", "position")
