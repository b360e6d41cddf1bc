"""Joins of a large fact with tables that may or may not be small."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Join a fact with a dimension; nothing is run while the plan is built.

    Whether the dimension is broadcast is left to Spark, which goes by its size
    in bytes, before the run and again while it runs; a hot key of a shuffled
    join is split by adaptive execution. A caller who knows of a key that holds
    much of the fact can ask for ``salts``: the dimension is repeated so many
    times and the rows of the fact, equal ones too, are dealt over the copies in
    turn. ``how`` is inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    keys = [on] if isinstance(on, str) else list(on)
    if salts is None:
        return fact.join(dim, keys, how)
    deal = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    joined = fact.withColumn("_salt", deal).join(
        dim.withColumn("_salt", copies), [*keys, "_salt"], how
    )
    return joined.drop("_salt")


def dimension_enrich(fact: DataFrame, organisation: DataFrame) -> DataFrame:
    """Add the organisation columns of each service; several organisation rows
    for a service give as many rows, none leaves nulls."""
    return lookup_join(fact, organisation, "service_id")


def common_ids(a: DataFrame, b: DataFrame, key: str = "service_id") -> DataFrame:
    """Ids that occur in both tables, each once. Both sides are reduced to
    distinct ids, partly before any shuffle, and only those meet."""
    known = F.col(key).isNotNull()
    ids_a, ids_b = (t.select(key).filter(known).distinct() for t in (a, b))
    return ids_a.join(ids_b, key, "left_semi")


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "service_id") -> DataFrame:
    """Rows whose id is listed."""
    return df.join(ids.select(key), key, "left_semi")


def dealt_join(
    fact: DataFrame, few: DataFrame, on: Sequence[str], salts: int = 1, within: Column | None = None, how: str = "left"
) -> DataFrame:
    """``fact`` with the other columns of ``few``, by keys of which null equals null.

    Rows of the fact are dealt in turn over ``salts`` copies of ``few``. ``within``
    is a further condition on columns of both.
    """
    own = [f"_of_{k}" for k in on]
    other = few.withColumnsRenamed(dict(zip(on, own)))
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(on, own)], F.lit(True) if within is None else within)
    if salts > 1:
        fact = fact.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        other = other.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        match = match & (F.col("_salt") == F.col("_copy"))
    return fact.join(other, match, how).drop(*own, "_salt", "_copy")


# Where an interval without a start or an end reaches to.
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def merged_intervals(windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, start, end): the union of the closed intervals of each key, as
    intervals that neither overlap nor touch. A null start or end is open.

    An interval opens a new island where it starts past the furthest end of all
    that start before it. Of intervals with one start only the longest matters,
    so a key has at most one row per day of the calendar in that window,
    whatever its share of the table.
    """
    start = F.coalesce("start", F.lit(FIRST_DAY).cast("date"))
    end = F.coalesce("end", F.lit(LAST_DAY).cast("date"))
    known = windows.select(*keys, start.alias("start"), end.alias("end")).filter("start <= end")
    longest = known.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy(*keys).orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.datediff("start", reach) <= 1, 0).otherwise(1)
    island = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        longest.withColumn("_fresh", fresh).withColumn("_island", island)
        .groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_island")
    )


# Days of a bucket of the range join.
BUCKET_DAYS = 64


def in_intervals(
    df: DataFrame, windows: DataFrame, on: Sequence[str] = (), date: str = "date", how: str = "left",
    salts: int = 1, days: int = BUCKET_DAYS,
) -> DataFrame:
    """``df`` joined with the intervals (on, start, end, ...) its date lies in.

    Intervals are cut at the edges of buckets of ``days`` days, within the span of
    the dates of ``df``: a date meets the pieces of its own bucket by equality and
    then the exact bounds. No day is unfolded, and an open interval or one of
    centuries has one row per bucket that the data can reach.
    """
    bucket = lambda d: F.floor(F.unix_date(d) / days).cast("long")
    spanned = df.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi")).alias("span"))
    reached = windows.withColumn("_span", spanned.scalar()).withColumns({
        "_lo": F.greatest("start", "_span.lo"), "_hi": F.least("end", "_span.hi")
    }).filter("_lo <= _hi")
    pieces = reached.withColumn("_bucket", F.explode(F.sequence(bucket("_lo"), bucket("_hi")))).drop("_span", "_lo", "_hi")
    inside = F.col(date).between(F.col("_start"), F.col("_end"))
    renamed = pieces.withColumnsRenamed({"start": "_start", "end": "_end"})
    dated = df.withColumn("_bucket", bucket(date))
    return dealt_join(dated, renamed, [*on, "_bucket"], salts, inside, how).drop("_bucket", "_start", "_end")


def label_intervals(
    df: DataFrame, windows: DataFrame, how: str = "left", on: Sequence[str] = (), salts: int = 1
) -> DataFrame:
    """Add the label of each interval (start, end, label) a date lies in; with
    ``on`` intervals hold for the rows of their key. Overlapping intervals of one
    label give one row, those of several labels one each."""
    merged = merged_intervals(windows, [*on, "label"])
    return in_intervals(df, merged, on, how=how, salts=salts)
