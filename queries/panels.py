"""Demand panels built from the given tables, and the same panels in SQL.

H: hourly count of events by type, with a small organisation above it.
D: daily count of orders by market segment and priority.
L: daily count of line items by supplier, with its nation and region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.grid import DAILY, HOURLY, fill_grid
from slotcast.operators.joins import lookup_join


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("event_type")
    desk = F.col("user_id") % 3
    return (
        table(spark, sf, "events")
        .groupBy(
            F.col("event_type").alias("service_id"),
            F.concat(F.lit("sector "), desk).alias("sector"),
            F.concat(F.lit("unit "), (desk + size) % 2).alias("unit"),
            F.concat(F.lit("client "), size % 2).alias("client"),
            F.to_date("ts").alias("date"),
            F.hour("ts").alias("hour"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("demand"))
    )


def hourly_by_user(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly count of events by user: many services, each seen on few days."""
    return (
        table(spark, sf, "events")
        .groupBy(
            F.col("user_id").alias("service_id"), F.to_date("ts").alias("date"),
            F.hour("ts").alias("hour"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("demand"))
    )


def hourly_dense(spark: SparkSession, sf: str) -> DataFrame:
    return fill_grid(hourly(spark, sf), HOURLY, fill=0.0)


def daily(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("service_id")
    )
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"
    )
    return (
        lookup_join(orders, customer, "o_custkey", "inner")
        .groupBy(
            "service_id",
            F.col("o_orderpriority").alias("sector"),
            F.to_date("o_orderdate").alias("date"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("demand"))
    )


def daily_dense(spark: SparkSession, sf: str) -> DataFrame:
    return fill_grid(daily(spark, sf), DAILY, fill=0.0)


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """The organisation table of L: one row per supplier."""
    nation = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return (
        table(spark, sf, "supplier")
        .join(nation, "s_nationkey", "left")
        .join(region, "n_regionkey", "left")
        .select(
            F.col("s_suppkey").alias("service_id"), F.col("s_name").alias("service_name"),
            F.col("n_name").alias("sector"), F.col("r_name").alias("unit"),
        )
    )


def shipped(spark: SparkSession, sf: str) -> DataFrame:
    """L without its organisation; summed before anything is joined to it."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("service_id"), F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_quantity").alias("demand"))
    )


def shipped_by_unit(spark: SparkSession, sf: str) -> DataFrame:
    return lookup_join(shipped(spark, sf), suppliers(spark, sf), "service_id")


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Rain derived from the events of each day, 0 to 3 mm; to show how gaps
    are treated, three days of a month have no row and three no figure."""
    errors = F.count(F.when(F.col("event_type") == "error", F.lit(1)))
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(
        errors.alias("errors")
    )
    known = F.when(~F.day("date").isin(5, 15, 25), (F.col("errors") % 4).cast("double"))
    return days.filter(~F.day("date").isin(10, 20, 30)).select("date", known.alias("precip_mm"))


HOURLY_SQL = """
h AS (
  SELECT event_type AS service_id,
         'sector ' || CAST(user_id % 3 AS VARCHAR) AS sector,
         'unit ' || CAST((user_id % 3 + length(event_type)) % 2 AS VARCHAR) AS unit,
         'client ' || CAST(length(event_type) % 2 AS VARCHAR) AS client,
         CAST(ts AS DATE) AS date, hour(ts) AS hour, CAST(count(*) AS DOUBLE) AS demand
  FROM events GROUP BY ALL)"""

USERS_SQL = """
u AS (
  SELECT user_id AS service_id, CAST(ts AS DATE) AS date, hour(ts) AS hour,
         CAST(count(*) AS DOUBLE) AS demand
  FROM events GROUP BY ALL)"""

HOURLY_DENSE_SQL = HOURLY_SQL + """,
hb AS (
  SELECT service_id, sector, min(date + hour * INTERVAL 1 HOUR) AS lo,
         max(date + hour * INTERVAL 1 HOUR) AS hi
  FROM h GROUP BY ALL),
hs AS (
  SELECT service_id, sector, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS t FROM hb),
hd AS (
  SELECT s.service_id, s.sector, CAST(s.t AS DATE) AS date, hour(s.t) AS hour,
         CASE WHEN h.service_id IS NULL THEN 0.0 ELSE h.demand END AS demand
  FROM hs s LEFT JOIN h ON h.service_id = s.service_id AND h.sector = s.sector
    AND h.date = CAST(s.t AS DATE) AND h.hour = hour(s.t))"""

DAILY_SQL = """
d AS (
  SELECT c_mktsegment AS service_id, o_orderpriority AS sector,
         CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS demand
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""

DAILY_DENSE_SQL = DAILY_SQL + """,
db AS (SELECT service_id, sector, min(date) AS lo, max(date) AS hi FROM d GROUP BY ALL),
ds AS (
  SELECT service_id, sector, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM db),
dd AS (
  SELECT s.service_id, s.sector, s.date,
         CASE WHEN d.service_id IS NULL THEN 0.0 ELSE d.demand END AS demand
  FROM ds s LEFT JOIN d ON d.service_id = s.service_id AND d.sector = s.sector
    AND d.date = s.date)"""

SHIPPED_SQL = """
l AS (
  SELECT l_suppkey AS service_id, s_name AS service_name, n_name AS sector, r_name AS unit,
         CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS demand
  FROM lineitem
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""

WEATHER_SQL = """
wx AS (
  SELECT CAST(ts AS DATE) AS date,
         CASE WHEN day(CAST(ts AS DATE)) NOT IN (5, 15, 25)
              THEN CAST(count(*) FILTER (event_type = 'error') % 4 AS DOUBLE) END AS precip_mm
  FROM events WHERE day(CAST(ts AS DATE)) NOT IN (10, 20, 30) GROUP BY CAST(ts AS DATE))"""
