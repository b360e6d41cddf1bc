import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotcast.functions.rows import not_negative, row_mean
from slotcast.grid import DAILY, HOURLY
from slotcast.operators import features
from slotcast.operators.codes import code_table, with_codes
from tests.frames import day, panel, rows


def series(seed=1, hours=900, gaps=0.1, keys=((1, "a"), (1, "b"), (2, "a"))):
    rng = np.random.default_rng(seed)
    frames = []
    for service, sector in keys:
        at = pd.date_range("2024-01-01", periods=hours, freq="h")
        frame = pd.DataFrame({"service_id": service, "sector": sector, "date": at.date,
                              "hour": at.hour, "demand": rng.poisson(5, hours).astype(float)})
        frames.append(frame[rng.random(hours) >= gaps])
    return pd.concat(frames).sample(frac=1, random_state=seed)


SCHEMA = "service_id long, sector string, date date, hour int, demand double"


def expected_lags(frame):
    f = frame.sort_values(["service_id", "sector", "date", "hour"]).reset_index(drop=True)
    g = f.groupby(["service_id", "sector"])["demand"]
    for k in (1, 2, 3, 4):
        f[f"lag_{k}w"] = g.shift(168 * k)
    for d in (1, 2, 3):
        f[f"lag_{24 * d}h"] = g.shift(168 + 24 * d)
    for n in (3, 6, 24):
        f[f"roll_mean_{n}h"] = g.transform(lambda s, n=n: s.shift(169).rolling(n).mean())
    for k in (2, 3, 4):
        f[f"same_hour_mean_{k}w"] = f[[f"lag_{i}w" for i in range(1, k + 1)]].mean(axis=1)
    f["same_hour_wavg_4w"] = 0.4 * f.lag_1w + 0.3 * f.lag_2w + 0.2 * f.lag_3w + 0.1 * f.lag_4w
    return f


@pytest.mark.parametrize("gaps", [0.0, 0.2])
def test_lags_equal_pandas(spark, gaps):
    frame = series(gaps=gaps)
    want = expected_lags(frame)
    got = features.with_lags(spark.createDataFrame(frame, SCHEMA)).toPandas()
    got = got.sort_values(["service_id", "sector", "date", "hour"]).reset_index(drop=True)
    for name in features.LAG_FEATURES:
        assert np.allclose(got[name].astype(float), want[name], equal_nan=True), name


def test_rolling_mean_needs_every_value(spark):
    frame = series(hours=260, gaps=0.0, keys=((1, "a"),)).sort_values(["date", "hour"])
    frame.iloc[5, frame.columns.get_loc("demand")] = np.nan
    df = spark.createDataFrame(frame, SCHEMA).withColumn("demand", F.nanvl("demand", F.lit(None)))
    want = expected_lags(frame)
    got = features.with_lags(df).toPandas().sort_values(["date", "hour"])
    for n in (3, 6, 24):
        name = f"roll_mean_{n}h"
        assert np.allclose(got[name].astype(float), want[name].values, equal_nan=True)


def test_offsets_equal_nine_joins(spark):
    frame = series(hours=1200, gaps=0.3)
    keys = ["service_id", "sector", "date", "hour"]
    want = frame.copy()
    for name, days in [(features.past(k), 7 * k) for k in (1, 2, 3, 4)] + [
        (features.ahead(k), -7 * k) for k in (1, 2, 3, 4, 5)
    ]:
        other = frame.rename(columns={"demand": name})
        other["date"] = other["date"] + dt.timedelta(days=days)
        want = want.merge(other, on=keys, how="left")
    want = want.sort_values(keys).reset_index(drop=True)
    got = features.with_offsets(spark.createDataFrame(frame, SCHEMA)).toPandas()
    got = got.sort_values(keys).reset_index(drop=True)
    assert len(got) == len(want)
    for name in want.columns[5:]:
        assert np.allclose(got[name].astype(float), want[name], equal_nan=True), name


def test_offset_sign(spark):
    p = panel(spark, [(1, "a", "2024-01-01", 3, 5.0), (1, "a", "2024-01-08", 3, 9.0)])
    got = features.with_offsets(p).select("date", "w_minus_1", "w_plus_1")
    assert rows(got, "date") == [(day("2024-01-01"), None, 9.0), (day("2024-01-08"), 5.0, None)]


def test_offset_there_and_back(spark):
    p = spark.createDataFrame(series(hours=800, gaps=0.2), SCHEMA)
    ahead = features.with_offsets(p, back=(), forward=(1,)).filter("w_plus_1 IS NOT NULL")
    moved = ahead.withColumns({"demand": F.col("w_plus_1"), "date": F.date_add("date", 7)})
    assert moved.select(*p.columns).exceptAll(p).count() == 0


def test_no_feature_uses_a_later_day(spark):
    frame = series(hours=1000, gaps=0.0, keys=((1, "a"),))
    cut = dt.date(2024, 2, 5)
    changed = frame.copy()
    changed.loc[changed["date"] >= cut, "demand"] += 1000
    names = [*features.LAG_FEATURES, *[features.past(k) for k in features.BACK]]
    got = [
        rows(features.with_features(spark.createDataFrame(f, SCHEMA))
             .filter(F.col("date") < F.lit(cut)).select("date", "hour", *names), "date", "hour")
        for f in (frame, changed)
    ]
    assert got[0] == got[1]


def test_all_series_features_share_one_shuffle(spark):
    p = spark.createDataFrame(series(hours=30), SCHEMA)
    plan = features.with_features(p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Window [") == 1 and plan.count("Sort [") == 1


def test_null_sector_has_offsets_but_no_lags(spark):
    frame = series(hours=400, gaps=0.0, keys=((1, "a"),))
    df = spark.createDataFrame(frame, SCHEMA).withColumn("sector", F.lit(None).cast("string"))
    got = features.with_features(df)
    assert got.filter("w_minus_1 IS NOT NULL").count() == 400 - 168
    assert got.filter("lag_1w IS NOT NULL").count() == 0


def test_row_mean_and_clip(spark):
    df = spark.createDataFrame([(1.0, None, 4.0), (None, None, None), (-2.0, 1.0, 1.0)],
                               "a double, b double, c double")
    got = df.select(row_mean("a", "b", "c"), not_negative("a")).collect()
    assert [tuple(r) for r in got] == [(2.5, 1.0), (None, None), (0.0, 0.0)]


def test_codes_equal_pandas(spark):
    rng = np.random.default_rng(5)
    values = [None if v == 13 else f"s{v}" for v in rng.integers(0, 300, 3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "service_id long, sector string")
    got = with_codes(df.repartition(7), {"sector": "sector_code"}).orderBy("service_id").toPandas()
    want = pd.Series(values).astype("category").cat.codes
    assert list(got["sector_code"]) == list(want)
    assert want.min() == -1


def test_codes_run_through_all_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.range(0, 50_000, 5).selectExpr("id * id AS service_id")
        got = code_table(df, "service_id", "code")
        assert got.selectExpr("count(DISTINCT code)", "min(code)", "max(code)").first()[:] == (
            10_000, 0, 9_999)
        bad = got.selectExpr("code", "lag(service_id) OVER (ORDER BY code) < service_id AS up")
        assert bad.filter("NOT up").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_calendar_features(spark):
    p = panel(spark, [(1, "a", "2024-12-30", 0, 1.0)])
    r = features.with_calendar(p, HOURLY).first()
    assert (r["weekday"], r["month"], r["day"], r["weekofyear"], r["dayofyear"], r["quarter"]) == (
        0, 12, 30, 1, 365, 4)
    assert (r["weekday_sin"], r["weekday_cos"]) == (0.0, 1.0)


def test_feature_lists():
    assert len(features.linear_features(HOURLY)) == 19
    assert len(features.tree_features(HOURLY)) == 20
    assert len(features.backtest_features(HOURLY)) == 25
    assert len(features.tree_features(DAILY)) == 19
