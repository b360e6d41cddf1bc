"""Distribution of daily totals.

Everything here starts from one row per group and day, so a group never holds
more rows than the calendar has days, and exact quantiles are affordable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.operators.levels import BY_SECTOR_AND_UNIT, GROUP, KEY, Levels, group_columns, level_sums


def daily_totals(
    panel: DataFrame, levels: Levels = BY_SECTOR_AND_UNIT, value: str = "demand"
) -> DataFrame:
    """(level, group, key, date, total); a day whose values are all null totals 0."""
    sums = level_sums(panel, {"date": F.col("date")}, levels, value)
    return sums.select(*GROUP, "date", "total")


def daily_stats(totals: DataFrame) -> DataFrame:
    return totals.groupBy(*group_columns(totals)).agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("total").alias("mean"),
        F.median("total").alias("median"),
    ).drop(KEY)


def histogram(totals: DataFrame, value: str = "total") -> DataFrame:
    """Counts in bins of equal width by the Freedman-Diaconis rule, empty bins
    included. The last bin is closed; without spread there is one bin."""
    keys = group_columns(totals)
    group = Window.partitionBy(*keys)
    low, high = F.min(value).over(group), F.max(value).over(group)
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(group)
    known = totals.filter(F.col(value).isNotNull()).withColumns(
        {"_low": low, "_high": high, "_q": quartiles, "_n": F.count(value).over(group)}
    )
    width = 2 * (F.col("_q")[1] - F.col("_q")[0]) * F.pow(F.col("_n"), F.lit(-1.0 / 3.0))
    span = F.col("_high") - F.col("_low")
    bins = F.when((width > 0) & (span > 0), F.ceil(span / F.nullif(width, F.lit(0.0))))
    # A group of equal values gets one bin of width 1 around them.
    margin = F.when(F.col("_high") == F.col("_low"), F.lit(0.5)).otherwise(F.lit(0.0))
    sized = known.withColumns({
        "_bins": F.coalesce(bins, F.lit(1)).cast("long"),
        "_from": F.col("_low") - margin,
        "_to": F.col("_high") + margin,
    }).withColumn("_step", (F.col("_to") - F.col("_from")) / F.col("_bins"))

    def edge(i):
        inner = F.col("_from") + i * F.col("_step")
        return F.when(i >= F.col("_bins"), F.col("_to")).otherwise(inner)

    guess = F.least(
        F.floor((F.col(value) - F.col("_from")) / (F.col("_to") - F.col("_from")) * F.col("_bins")),
        F.col("_bins") - 1,
    )
    # The guess may be one off where a value lies on an edge.
    below = (F.col(value) < edge(F.col("_guess"))).cast("long")
    above = (F.col(value) >= edge(F.col("_guess") + 1)) & (F.col("_guess") < F.col("_bins") - 1)
    binned = sized.withColumn("_guess", guess).withColumn(
        "bin", F.col("_guess") - below + above.cast("long")
    )
    shape = ("_bins", "_from", "_to", "_step")
    counted = binned.groupBy(*keys, *shape, "bin").agg(F.count(F.lit(1)).alias("days"))
    # Each occupied bin also writes the empty ones up to the next occupied bin.
    order = Window.partitionBy(*keys).orderBy("bin")
    last = F.coalesce(F.lead("bin").over(order), F.col("_bins")) - 1
    every = F.explode(F.sequence(F.col("bin"), F.col("_until")))
    spread = counted.withColumn("_until", last).withColumn("_bin", every)
    days = F.when(F.col("_bin") == F.col("bin"), F.col("days")).otherwise(F.lit(0))
    return spread.select(
        "level", "group", F.col("_bin").alias("bin"),
        edge(F.col("_bin")).alias("bin_from"), edge(F.col("_bin") + 1).alias("bin_to"),
        days.cast("long").alias("days"),
    )
