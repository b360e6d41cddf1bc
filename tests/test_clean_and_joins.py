import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slotcast.grid import HOURLY, consolidate, duplicate_slots, fill_grid
from slotcast.operators import joins
from slotcast.operators.clean import as_of, repair_raw_spikes, repair_spikes
from slotcast.operators.series import interval_means_of
from tests.frames import day, panel, rows


def weeks(spark, *values, start="2024-03-01"):
    import datetime as dt

    first = day(start)
    return panel(spark, [
        (1, "a", str(first + dt.timedelta(days=7 * i)), 8, v)
        for i, v in enumerate(values) if v is not None
    ])


@pytest.mark.parametrize("values, middle", [
    ((10.0, 40.0, 14.0), 12.0),
    ((None, 40.0, 14.0), 14.0),
    ((10.0, 40.0, None), 10.0),
    ((None, 40.0, None), 40.0),
    ((1.0, 10.0, 1.0), 10.0),
    ((12.0, 24.0, 12.0), 24.0),
])
def test_spike_repair(spark, values, middle):
    got = repair_spikes(weeks(spark, *values)).filter(F.col("date") == "2024-03-08")
    assert [r["demand"] for r in got.collect()] == [middle]


def test_repair_uses_raw_neighbours_once(spark):
    got = repair_spikes(weeks(spark, 5.0, 30.0, 100.0, 5.0))
    assert [r[0] for r in got.orderBy("date").select("demand").collect()] == [5.0, 30.0, 17.5, 5.0]


def test_neighbours_keep_to_hour_and_sector(spark):
    p = panel(spark, [(1, "a", "2024-03-01", 8, 1.0), (1, "a", "2024-03-08", 9, 40.0),
                      (1, "b", "2024-03-08", 8, 40.0), (2, "a", "2024-03-15", 8, 1.0)])
    assert rows(repair_spikes(p), "service_id", "sector", "date") == rows(
        p, "service_id", "sector", "date")


def test_cleaning_shuffles_once_and_joins_nothing(spark):
    plan = repair_spikes(weeks(spark, 1.0, 2.0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_as_of_is_inclusive(spark):
    assert as_of(weeks(spark, 1.0, 2.0, 3.0), "2024-03-08").count() == 2


def test_consolidate_and_duplicates(spark):
    p = panel(spark, [(1, "a", "2024-03-01", 8, 1.0)] * 3 + [(1, "a", "2024-03-01", 9, 1.0)])
    assert rows(duplicate_slots(p, HOURLY), "hour") == [(1, "a", day("2024-03-01"), 8, 3)]
    once = consolidate(p)
    assert rows(once, "hour")[0][-1] == 3.0 and duplicate_slots(once).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    fact = spark.range(3000).select(
        F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 50).cast("long").alias("k"),
        F.col("id").alias("v"))
    dim = spark.range(40).selectExpr("id AS k", "id * 10 AS d").union(
        spark.sql("SELECT 7L AS k, 71L AS d"))
    salted = joins.lookup_join(fact, dim, "k", how, salts=8)
    plain = fact.join(dim, "k", how)
    assert rows(salted, "k", "v", "d") == rows(plain, "k", "v", "d")


@pytest.mark.parametrize("equal", [True, False])
def test_hot_key_is_spread_over_the_copies(spark, equal):
    """Equal rows too, and rows with a map."""
    v = F.lit(1) if equal else F.col("id")
    fact = spark.range(1000).select(F.lit(7).cast("long").alias("k"), F.create_map(v, v).alias("m"))
    dim = spark.range(1000).selectExpr("id AS k", "id AS d")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = joins.lookup_join(fact, dim, "k", salts=16)
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        parts = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 4 and sum(r["count"] for r in parts) == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_building_a_plan_starts_no_job(spark):
    from queries import QUERIES

    tracker = spark.sparkContext.statusTracker()
    QUERIES["month_profile"](spark, "/root/testdata/sf0.001")  # files are listed and schemas read once
    spark.sparkContext.setJobGroup("plan", "plan")
    fact, dim = spark.range(10).selectExpr("id AS k"), spark.range(10).selectExpr("id AS k", "id AS d")
    joins.lookup_join(fact, dim, "k")
    joins.lookup_join(fact, dim, "k", salts=4)
    joins.keep_ids(fact, dim.select("k"), "k")
    assert tracker.getJobIdsForGroup("plan") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_small_dimension_is_broadcast(spark):
    fact = spark.range(100).selectExpr("id AS k")
    joined = joins.lookup_join(fact, spark.range(10).selectExpr("id AS k", "id AS d"), "k")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_common_ids_is_a_subset_of_both(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "service_id long")
    b = spark.createDataFrame([(2,), (3,), (None,)], "service_id long")
    assert rows(joins.common_ids(a, b), "service_id") == [(2,)]
    assert rows(joins.keep_ids(a, joins.common_ids(a, b)), "service_id") == [(2,)]


def test_interval_edges_are_inside(spark):
    p = panel(spark, [(1, "a", d, 0, 1.0) for d in
                      ("2024-01-31", "2024-02-01", "2024-04-30", "2024-05-01")])
    w = spark.sql("SELECT date'2024-02-01' AS start, date'2024-04-30' AS end, 'x' AS label")
    got = rows(joins.label_intervals(p, w).select("date", "label"), "date")
    assert [label for _, label in got] == [None, "x", "x", None]


def intervals(spark, rows_):
    """(label, start, end) rows; None is open."""
    fixed = [(label, s and day(s), e and day(e)) for label, s, e in rows_]
    return spark.createDataFrame(fixed, "label string, start date, end date")


def test_open_and_very_long_intervals(spark):
    dates = ["1999-12-31", "2000-01-01", "2010-06-05", "2024-02-29", "2199-12-31", "2200-01-01"]
    p = panel(spark, [(1, "a", d, 0, 1.0) for d in dates] + [(1, "a", None, 0, 1.0)])
    w = intervals(spark, [("long", "1900-01-01", "2199-12-31"), ("from", "2010-06-05", None), ("to", None, "2000-01-01"),
                          ("ever", None, None), ("mistyped", "2024-02-01", "9999-04-30"), ("none", "2024-03-01", "2024-02-01")])
    got = joins.label_intervals(p, w, "inner").select(F.col("date").cast("string"), "label").collect()
    want = {("ever", d) for d in dates} | {("long", d) for d in dates[:5]} | {("from", d) for d in dates[2:]}
    want |= {("to", d) for d in dates[:2]} | {("mistyped", d) for d in dates[3:]}
    assert {(r[1], r[0]) for r in got} == want and len(got) == len(want)
    assert joins.label_intervals(p, w).filter("date IS NULL AND label IS NULL").count() == 1
    assert joins.label_intervals(p.limit(0), w).count() == 0
    assert joins.label_intervals(p, w.limit(0)).filter("label IS NULL").count() == 7


@pytest.mark.parametrize("salts, days", [(1, 1), (1, 64), (8, 7), (3, 10_000)])
def test_intervals_equal_a_plain_comparison(spark, salts, days):
    draw = random.Random(salts * days)
    first = day("2020-01-01")
    at = lambda n: first + dt.timedelta(days=n)
    given = [(draw.choice("ab"), draw.choice("xyz"), s := draw.randint(0, 900), s + draw.randint(-3, 200)) for _ in range(60)]
    windows = spark.createDataFrame([(k, label, at(s), at(e)) for k, label, s, e in given], "sector string, label string, start date, end date")
    facts = [(draw.choice(["a", "b", "c", None]), draw.randint(-10, 1100)) for _ in range(300)]
    frame = spark.createDataFrame([(i, k, at(n)) for i, (k, n) in enumerate(facts)], "id long, sector string, date date")
    merged = joins.merged_intervals(windows, ["sector", "label"])
    got = joins.in_intervals(frame, merged, ["sector"], how="inner", salts=salts, days=days).select("id", "label").collect()
    want = {(i, label) for i, (k, n) in enumerate(facts) for q, label, s, e in given if q == k and s <= n <= e}
    assert sorted(map(tuple, got)) == sorted(want)


def test_merged_intervals(spark):
    w = intervals(spark, [("a", "2024-01-05", "2024-01-10"), ("a", "2024-01-01", "2024-01-03"), ("a", "2024-01-04", "2024-01-04"),
                          ("a", "2024-01-12", "2024-01-20"), ("a", "2024-01-13", "2024-01-14"), ("a", "2024-01-21", "2024-01-25"),
                          ("b", "2024-01-08", "2024-01-30"), ("b", "2024-01-08", None), ("c", "2024-02-02", "2024-02-01")])
    got = joins.merged_intervals(w, ["label"]).select("label", F.col("start").cast("string"), F.col("end").cast("string"))
    assert rows(got, "label", "start") == [
        ("a", "2024-01-01", "2024-01-10"), ("a", "2024-01-12", "2024-01-25"), ("b", "2024-01-08", "9999-12-31")]


def test_means_of_a_union_count_a_day_once(spark):
    totals = spark.createDataFrame(
        [("sector", g, day(f"2024-01-{d:02d}"), float(d)) for g in "ab" for d in range(1, 11)], "level string, group string, date date, total double")
    windows = spark.createDataFrame(
        [("sector", "a", day("2024-01-02"), day("2024-01-04")), ("sector", "a", day("2024-01-03"), day("2024-01-06"))],
        "level string, group string, start date, end date")
    got = rows(interval_means_of(totals, windows, ["level", "group"]), "group")
    assert got == [("sector", "a", 4.0, 7.0, 5), ("sector", "b", None, 5.5, 0)]


def raw_rows(spark, hot=0):
    """Raw rows with several to a slot, services without a sector, rows without a date."""
    draw = random.Random(7)
    made = []
    for _ in range(2000):
        d = None if draw.random() < 0.03 else f"2024-03-{draw.choice((1, 8, 15, 22)):02d}"
        made.append((draw.randint(1, 6), draw.choice(["a", "b", None]), d, draw.choice((8, 9)), float(draw.choice((1, 2, 3, 40, 90)))))
    made += [(1, "a", "2024-03-08", 8, 500.0)] * hot
    return panel(spark, made)


def test_raw_repair_equals_the_window(spark):
    p = raw_rows(spark).withColumn("demand", F.when(F.rand(3) < 0.9, F.col("demand")))
    p = spark.createDataFrame(p.collect(), p.schema)
    order = ("service_id", "sector", "date", "hour", "demand")
    one, other = (rows(f(p, factor=1.5).withColumn("demand", F.round("demand", 9)), *order) for f in (repair_spikes, repair_raw_spikes))
    assert one == other and one != rows(p, *order)


def test_raw_repair_spreads_a_hot_slot(spark):
    """A slot with most of the table: its rows are dealt over tasks, and no window meets raw rows."""
    p = raw_rows(spark, hot=30_000)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    try:
        fixed = repair_raw_spikes(p, salts=64)
        plan = fixed._jdf.queryExecution().executedPlan().toString()
        sizes = sorted(r["count"] for r in fixed.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 4 and sizes[-1] <= 2 * (sizes[1] + sizes[2]) / 2
        below = plan[plan.index("Window") :]
        assert plan.count("Window") == 1 and "HashAggregate" in below
        assert fixed.filter("demand = 500").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.enabled", True)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_a_gap_of_a_mistyped_year_ends_the_job(spark):
    p = panel(spark, [(1, "a", "2024-03-01", 8, 1.0), (1, "a", "9999-03-01", 8, 1.0)])
    with pytest.raises(Exception, match="gap too long"):
        fill_grid(p).count()


def test_rows_without_a_slot_have_no_neighbours(spark):
    p = panel(spark, [(1, "a", "2024-03-01", 8, 1.0), (1, "a", "2024-03-08", 8, 50.0),
                      (1, "a", "2024-03-15", 8, 1.0)])
    undated = p.withColumn("date", F.lit(None).cast("date")).withColumn("demand", F.lit(60.0))
    got = repair_spikes(p.union(undated)).orderBy(F.col("date").asc_nulls_last(), "demand")
    assert [r["demand"] for r in got.collect()] == [1.0, 1.0, 1.0, 60.0, 60.0, 60.0]


def test_a_neighbour_slot_with_several_rows_counts_with_their_mean(spark):
    p = panel(spark, [(1, "a", "2024-03-01", 8, 2.0), (1, "a", "2024-03-01", 8, 4.0),
                      (1, "a", "2024-03-08", 8, 50.0), (1, "a", "2024-03-08", 8, 3.0)])
    got = repair_spikes(p)
    assert sorted(r["demand"] for r in got.collect()) == [2.0, 3.0, 3.0, 4.0]
