"""Daily rain from a landed weather response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "daily struct<time: array<string>, precipitation_sum: array<double>>"


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON responses to one row per day."""
    return weather_days(spark.read.schema(PAYLOAD).option("multiLine", True).json(path))


def weather_days(payload: DataFrame) -> DataFrame:
    """Two parallel arrays in the struct ``daily`` to one row per day."""
    days = payload.select(
        F.explode(F.arrays_zip("daily.time", "daily.precipitation_sum")).alias("d")
    )
    return days.select(
        F.col("d.time").try_cast("date").alias("date"),
        F.nanvl("d.precipitation_sum", F.lit(None).cast("double")).alias("precip_mm"),
    )


def rained(precip: str = "precip_mm", mm: float = 1.0) -> Column:
    """More rain than ``mm``; a day without a figure counts as dry."""
    return F.coalesce(~F.isnan(precip) & (F.col(precip) > F.lit(mm)), F.lit(False))
