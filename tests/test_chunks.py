"""Frames over chunks of rows, exponentially weighted means and rolling medians."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slotcast.grid import DAILY, Grid
from slotcast.operators import chunks, smoothing
from slotcast.operators.features import LAG_FEATURES, with_lags
from tests.frames import rows

FIRST = dt.date(2024, 1, 1)


def series(spark, sizes, gaps=0.0, missing=0.0, undated=0, seed=1):
    """Daily series of the given sizes, with gaps in the calendar and missing values."""
    draw = random.Random(seed)
    made = []
    for i, n in enumerate(sizes):
        day, key = FIRST, (i, None if i == 2 else "a")
        for _ in range(n):
            day += dt.timedelta(days=draw.randint(2, 40) if draw.random() < gaps else 1)
            made.append((*key, day, None if draw.random() < missing else round(draw.random() * 100, 3)))
        made += [(*key, None, float(k)) for k in range(undated)]
    draw.shuffle(made)
    return spark.createDataFrame(made, "service_id long, sector string, date date, demand double").repartition(4)


def comparable(df, columns):
    kept = df.filter("date IS NOT NULL").select(
        "service_id", "sector", "date", *[F.round(c, 6).alias(c) for c in columns])
    return rows(kept, "service_id", "sector", "date")


@pytest.mark.parametrize("size", [1, 7, 29, 100, 5000])
def test_lags_equal_those_of_whole_series(spark, size):
    p = series(spark, (300, 40, 120, 1), gaps=0.1, missing=0.1, undated=3, seed=size)
    got = chunks.with_lags_in_chunks(p, DAILY, size)
    whole = with_lags(p, DAILY)
    assert set(got.columns) == set(whole.columns)
    assert comparable(got, ["demand", *LAG_FEATURES]) == comparable(whole, ["demand", *LAG_FEATURES])
    assert got.count() == p.count()


@pytest.mark.parametrize("stretch", [1, 5, 1000])
def test_places_count_rows(spark, stretch):
    p = series(spark, (90, 30), gaps=0.2, undated=2)
    got = chunks.placed(p, DAILY, stretch).select("service_id", "date", chunks.PLACE).collect()
    for key in (0, 1):
        own = sorted((r[chunks.PLACE], r["date"]) for r in got if r["service_id"] == key)
        assert [n for n, _ in own] == list(range(len(own)))
        dated = [d for _, d in own if d is not None]
        assert dated == sorted(dated) and all(d is None for _, d in own[len(dated):])


def test_a_long_series_is_spread_over_chunks(spark):
    p = series(spark, (4000,))
    seen = {}

    def columns(window):
        seen["window"] = window
        return {"n": F.count(F.lit(1)).over(Window.partitionBy(*DAILY.keys, chunks.CHUNK))}

    sizes = chunks.over_chunks(chunks.placed(p, DAILY), columns, 30, 100, DAILY)
    assert sizes.agg(F.max("n")).first()[0] == 130
    plan = chunks.with_lags_in_chunks(p, DAILY, 500)._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan and "Generate explode(sequence" in plan


def test_moving_mean_in_chunks(spark):
    p = series(spark, (60, 33), missing=0.2, seed=4)
    window = Window.partitionBy(*DAILY.keys).orderBy("date").rowsBetween(-6, 0)
    want = comparable(p.withColumn("moving_mean", F.avg("demand").over(window)), ["moving_mean"])
    for size in (1, 10, 1000):
        assert comparable(chunks.moving_mean_in_chunks(p, 7, DAILY, size), ["moving_mean"]) == want


def by_pandas(frame, make):
    pdf = frame.filter("date IS NOT NULL").toPandas().sort_values(["service_id", "date"])
    found = []
    for (key, sector), part in pdf.groupby(["service_id", "sector"], dropna=False):
        values = make(part["demand"] if isinstance(sector, str) else part["demand"] * np.nan)
        found += [(key, d, v) for d, v in zip(part["date"], values)]
    return sorted(found, key=lambda r: (r[0], r[1]))


def same(df, column, want):
    """Do the values of ``column`` equal those wanted, up to rounding?"""
    kept = df.filter("date IS NOT NULL").select("service_id", "date", column)
    got = sorted(map(tuple, kept.collect()), key=lambda r: (r[0], r[1]))
    number = lambda found: np.array([np.nan if v is None else v for *_, v in found], float)
    return [r[:2] for r in got] == [r[:2] for r in want] and np.allclose(number(got), number(want), equal_nan=True)


@pytest.mark.parametrize("size, missing, shift", [(1, 0.3, 0), (7, 0.3, 8), (64, 0.0, 8), (5000, 0.6, 3)])
def test_exponential_means_equal_pandas(spark, size, missing, shift):
    p = series(spark, (150, 20, 30, 1), missing=missing, undated=2, seed=size)
    got = smoothing.exponential_means(p, {"e3": 3, "e40": 40}, DAILY, size, shift)
    assert set(got.columns) == {*p.columns, "e3", "e40"} and got.count() == p.count()
    for name, span in (("e3", 3), ("e40", 40)):
        want = by_pandas(p, lambda s: s.shift(shift).ewm(span=span, adjust=False).mean())
        assert same(got, name, want)


def test_pairs_of_rows_make_one():
    """The pair of a chunk equals that of its parts, one after the other."""
    rng = np.random.default_rng(5)
    value = np.where(rng.random(200) < 0.3, np.nan, rng.random(200))
    place = np.arange(200)
    whole_f, whole_s = smoothing._steps(place, value, np.nan, 0.2)
    known = place[:77][~np.isnan(value[:77])].max()
    f, s = smoothing._steps(place[77:], value[77:], float(known), 0.2)
    mean = whole_s[76]
    assert np.allclose(f * mean + s, whole_s[77:])


@pytest.mark.parametrize("skip", [0, 3, 7])
def test_rolling_medians_equal_pandas(spark, skip):
    p = series(spark, (200, 25, 30, 2), missing=0.02, undated=2, seed=skip)
    widths = {"m1": 1, "m4": 4, "m9": 9}
    got = smoothing.rolling_medians(p, widths, DAILY, skip)
    assert got.columns == [*p.columns, *widths] and got.count() == p.count()
    for name, n in widths.items():
        want = by_pandas(p, lambda s: s.shift(skip + 1).rolling(n).median())
        assert same(got, name, want)


def test_rolling_medians_shuffle_once(spark, tmp_path):
    series(spark, (30,)).write.parquet(str(tmp_path / "p"))
    plan = smoothing.rolling_medians(spark.read.parquet(str(tmp_path / "p")), grid=DAILY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_equal_values_leave_a_frame_one_by_one():
    frame = smoothing._Sliding(3)
    given = [2.0, 2.0, 1.0, 2.0, 2.0, 5.0, 0.0, 0.0]
    got = [frame.step(x, given[i - 3] if i >= 3 else None) for i, x in enumerate(given)]
    assert got == [None, None, *[sorted(given[i - 2 : i + 1])[1] for i in range(2, 8)]]


def test_frames_of_a_panel_without_keys(spark):
    p = series(spark, (50,)).drop("service_id", "sector")
    grid = Grid(keys=(), hour=None)
    got = smoothing.rolling_medians(p.repartition(1), {"m": 3}, grid, 0)
    assert got.filter("m IS NOT NULL").count() == 47
