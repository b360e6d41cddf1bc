import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotcast.grid import DAILY, HOURLY, fill_grid, missing_slots
from slotcast.operators import contrast, distribution, profile, series
from slotcast.operators.levels import BY_UNIT_AND_SECTOR, OVERALL, level_sums
from tests.frames import day, panel, rows

ORG = "service_id long, sector string, client string, unit string, date date, hour int, demand double"


def org(spark, rows_):
    return panel(spark, rows_, ORG)


def test_hours_are_completed(spark):
    p = org(spark, [(1, "a", "c", "u", "2024-01-01", 8, 2.0), (1, "a", "c", "u", "2024-01-01", 9, 4.0)])
    got = profile.hour_profile(p).filter("level = 'overall'").orderBy("hour").collect()
    assert [r["hour"] for r in got] == list(range(24))
    assert sum(r["mean"] is None for r in got) == 22
    assert {r["reference_mean"] for r in got} == {3.0}
    assert {(r["peak_hour"], r["peak_mean"]) for r in got} == {(9, 4.0)}


def test_tied_peak_is_the_first(spark):
    p = org(spark, [(1, "a", "c", "u", "2024-01-01", h, 5.0) for h in (14, 9)])
    assert profile.hour_profile(p, OVERALL).first()["peak_hour"] == 9


def test_reference_is_a_mean_of_means(spark):
    p = org(spark, [(1, "a", "c", "u", "2024-01-01", 8, 10.0)]
            + [(i, "a", "c", "u", "2024-01-01", 9, 0.0) for i in range(9)])
    assert profile.hour_profile(p, OVERALL).first()["reference_mean"] == 5.0


def test_null_sector_is_in_the_overall_level_only(spark):
    p = org(spark, [(1, None, "c", "u", "2024-01-01", 8, 10.0), (1, "a", "c", "u", "2024-01-01", 8, 2.0)])
    got = profile.hour_profile(p).filter("hour = 8").select("level", "group", "mean")
    assert rows(got, "level") == [("client", "c", 6.0), ("overall", "all", 6.0), ("sector", "a", 2.0)]


def test_null_values_and_all_null_groups(spark):
    p = org(spark, [(1, "a", "c", "u", "2024-01-01", 8, None), (1, "b", "c", "u", "2024-01-01", 8, 3.0)])
    sums = level_sums(p, {"date": F.col("date")}, {"sector": ("sector",)})
    assert rows(sums.select("group", "total", "n"), "group") == [("a", 0.0, 0), ("b", 3.0, 1)]
    means = profile.hour_profile(p, {"sector": ("sector",)}).filter("hour = 8")
    got = rows(means.select("group", "mean", "peak_hour"), "group")
    assert got == [("a", None, None), ("b", 3.0, 8)]


def test_calendar_names(spark):
    p = org(spark, [(1, "a", "c", "u", "2024-02-05", 8, 1.0)])  # a Monday
    week = profile.weekday_profile(p, OVERALL).orderBy("weekday").collect()
    assert [r["weekday_name"] for r in week][0] == "Monday" and week[0]["mean"] == 1.0
    months = profile.month_profile(p, OVERALL).orderBy("month").collect()
    assert [r["month_name"] for r in months][:3] == ["Janeiro", "Fevereiro", "Março"]
    assert [r["mean"] for r in months][1] == 1.0 and len(months) == 12


def test_day_type_order(spark):
    p = org(spark, [(1, "a", "c", "u", "2024-02-03", 8, 9.0), (1, "a", "c", "u", "2024-02-05", 8, 1.0)])
    got = [(r["day_type"], r["mean"]) for r in profile.day_type_profile(p).collect()]
    assert got == [("Dia útil", 1.0), ("Fim de semana", 9.0)]


def test_matrix_belongs_to_the_group(spark):
    p = org(spark, [(1, "a", "c", "u", "2024-02-05", 8, 1.0), (1, "b", "c", "u", "2024-02-05", 8, 3.0)])
    got = profile.weekday_hour_matrix(p).filter("weekday = 0").select("level", "group", "h08", "h09")
    assert rows(got, "level", "group") == [
        ("client", "c", 2.0, None), ("overall", "all", 2.0, None),
        ("sector", "a", 1.0, None), ("sector", "b", 3.0, None)]
    assert profile.weekday_hour_matrix(p, OVERALL).count() == 7


def test_profile_reads_and_shuffles_the_panel_once(spark):
    p = org(spark, [(1, "a", "c", "u", "2024-01-01", 8, 1.0)])
    plan = profile.hour_profile(p)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 3


def test_holiday_against_other_days(spark):
    p = org(spark, [(1, "a", "c", "u", "2024-12-25", 8, 2.0), (1, "a", "c", "u", "2024-12-25", 9, 4.0),
                    (1, "a", "c", "u", "2024-12-26", 8, 10.0), (1, "b", "c", "u", "2024-12-26", 8, 20.0)])
    got = rows(contrast.holiday_contrast(p), "level", "group")
    assert got == [("client", "c", "Natal", 3.0, 15.0), ("overall", "all", "Natal", 3.0, 15.0),
                   ("sector", "a", "Natal", 3.0, 10.0)]


def weather(spark):
    return panel(spark, [("2024-01-01", 5.0), ("2024-01-02", 0.0), ("2024-01-03", None)],
                 "date date, precip_mm double")


def rain_panel(spark):
    return panel(spark, [
        (1, "a", "2024-01-01", 8, 10.0), (1, "a", "2024-01-02", 8, 4.0), (1, "a", "2024-01-03", 8, 2.0),
        (2, "a", "2024-01-01", 8, 99.0), (1, "a", "2024-01-04", 8, 1000.0)])


def test_rain_nulls_and_unknown_days(spark):
    got = contrast.rain_contrast(rain_panel(spark), weather(spark), "2024-01-01", "2024-12-31")
    assert got.count() == 24
    assert got.filter("hour = 8").first()[1:] == (54.5, 3.0)


def test_services_on_one_side_are_left_out_on_request(spark):
    got = contrast.rain_contrast(
        rain_panel(spark), weather(spark), "2024-01-01", "2024-12-31", common_services_only=True)
    assert got.filter("hour = 8").first()[1:] == (10.0, 3.0)


def test_season_is_used_as_given(spark):
    got = contrast.rain_contrast(rain_panel(spark), weather(spark), "2024-01-02", "2024-01-02")
    assert got.filter("hour = 8").first()[1:] == (None, 4.0)


def test_period_contrast(spark):
    p = org(spark, [(1, "a", "c", "u", d, 8, v) for d, v in
                    (("2024-01-31", 4.0), ("2024-02-01", 6.0), ("2024-04-30", 8.0), ("2024-05-01", 6.0))])
    assert rows(contrast.period_contrast(p, "2024-02-01", "2024-04-30"), "level") == [
        ("overall", "all", 7.0, 5.0, pytest.approx(40.0))]
    zero = p.withColumn("demand", F.when(F.col("demand") > 6, 1.0).otherwise(0.0))
    assert contrast.period_contrast(zero, "2024-04-30", "2024-04-30").first()["change_percent"] == 0.0
    empty = contrast.period_contrast(p, "2020-01-01", "2020-01-02").first()
    assert empty["inside_mean"] is None and empty["change_percent"] is None


def totals_of(spark, values, group="g"):
    data = [("x", group, float(v)) for v in values]
    return spark.createDataFrame(data, "level string, group string, total double")


@pytest.mark.parametrize("values", [
    list(np.random.default_rng(1).gamma(3, 40, 700)),
    list(np.random.default_rng(2).integers(0, 400, 1000) * 1.0),
    [1.0, 2.0, 2.0, 3.0, 1000.0],
    [5.0] * 9,
    [1.0, 1.0, 1.0, 1.0, 9.0],
    [0.1 * i for i in range(31)],
])
def test_histogram_equals_numpy(spark, values):
    counts, edges = np.histogram(np.array(values), bins="fd")
    got = distribution.histogram(totals_of(spark, values)).orderBy("bin").collect()
    assert [r["bin"] for r in got] == list(range(len(counts)))
    assert [r["days"] for r in got] == list(counts)
    assert np.allclose([r["bin_from"] for r in got], edges[:-1])
    assert np.allclose([r["bin_to"] for r in got], edges[1:])


def test_daily_stats(spark):
    got = distribution.daily_stats(totals_of(spark, [1, 2, 10, 40])).first()
    assert (got["days"], got["mean"], got["median"]) == (4, 13.25, 6.0)


def test_gap_days_are_filled_and_smoothed(spark):
    t = panel(spark, [("overall", "all", d, v) for d, v in
                      (("2024-01-01", 3.0), ("2024-01-02", 5.0), ("2024-01-05", 10.0))],
              "level string, group string, date date, total double")
    got = rows(series.smoothed(t).select("date", "total", "moving_mean"), "date")
    assert [r[1] for r in got] == [3.0, 5.0, None, None, 10.0]
    assert [r[2] for r in got] == [3.0, 4.0, 4.0, 4.0, 6.0]


def test_smoothing_equals_pandas(spark):
    rng = np.random.default_rng(3)
    days = sorted(rng.choice(400, 150, replace=False))
    dates = [pd.Timestamp("2023-01-01") + pd.Timedelta(days=int(d)) for d in days]
    values = rng.poisson(20, 150).astype(float)
    daily = pd.Series(values, index=dates).asfreq("D")
    expected = daily.rolling(7, min_periods=1).mean()
    t = spark.createDataFrame([("x", "g", d.date(), float(v)) for d, v in zip(dates, values)],
                              "level string, group string, date date, total double")
    got = series.smoothed(t).orderBy("date").toPandas()
    assert len(got) == len(expected)
    assert np.allclose(got["moving_mean"].astype(float), expected.values, equal_nan=True)


def test_filling_and_smoothing_share_a_shuffle(spark):
    t = panel(spark, [("x", "g", "2024-01-01", 1.0)], "level string, group string, date date, total double")
    plan = series.smoothed(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_interval_means_ignore_gap_days(spark):
    t = panel(spark, [("x", "g", d, v) for d, v in
                      (("2022-03-01", 4.0), ("2022-05-31", 6.0), ("2022-06-01", 1.0))],
              "level string, group string, date date, total double")
    got = series.interval_means(t, [("2022-03-01", "2022-05-31"), ("2023-03-15", "2023-05-31")])
    assert got.first()[2:] == (5.0, 1.0)


def test_hourly_grid(spark):
    p = panel(spark, [(1, "a", "2024-01-01", 22, 1.0), (1, "a", "2024-01-02", 1, 2.0),
                      (2, "a", "2024-01-01", 5, 3.0)])
    got = rows(fill_grid(p, HOURLY, fill=0.0), "service_id", "date", "hour")
    assert got == [(1, "a", day("2024-01-01"), 22, 1.0), (1, "a", day("2024-01-01"), 23, 0.0),
                   (1, "a", day("2024-01-02"), 0, 0.0), (1, "a", day("2024-01-02"), 1, 2.0),
                   (2, "a", day("2024-01-01"), 5, 3.0)]
    assert rows(missing_slots(p), "service_id") == [(1, "a", 2), (2, "a", 0)]
    assert missing_slots(fill_grid(p)).filter("missing > 0").count() == 0


def test_grid_keeps_null_values(spark):
    p = panel(spark, [(1, "a", "2024-01-01", None), (1, "a", "2024-01-03", 2.0)],
              "service_id long, sector string, date date, demand double")
    assert [r[-1] for r in rows(fill_grid(p, DAILY, fill=0.0), "date")] == [None, 0.0, 2.0]


def test_equal_labels_of_different_groups_stay_apart(spark):
    p = spark.createDataFrame(
        [("a - b", "c", day("2024-03-01"), 8, 1.0), ("a", "b - c", day("2024-03-01"), 8, 3.0)],
        "unit string, sector string, date date, hour int, demand double")
    got = profile.unit_sector_hours(p).filter("level = 'unit_sector' AND hour = 8")
    assert sorted((r["group"], r["mean"]) for r in got.collect()) == [("a - b - c", 1.0), ("a - b - c", 3.0)]
    totals = distribution.daily_totals(p, BY_UNIT_AND_SECTOR).filter("level = 'unit_sector'")
    assert sorted(r["mean"] for r in distribution.daily_stats(totals).collect()) == [1.0, 3.0]
    assert series.smoothed(totals).count() == 2
