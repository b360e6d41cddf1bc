import datetime as dt
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from slotcast.grid import DAILY
from slotcast.operators import backtest, features, linear, trees
from slotcast.plans import benchmarks
from tests.frames import rows

SCHEMA = "service_id long, sector string, date date, demand double"


def seasonal(seed=1, days=500, keys=((1, "a"), (1, "b"), (2, "a"))):
    """Weekly pattern and noise, one row per day."""
    rng = np.random.default_rng(seed)
    out = []
    for i, (service, sector) in enumerate(keys):
        level = np.array([20, 22, 24, 21, 18, 9, 7]) + 5 * i
        at = pd.date_range("2022-01-03", periods=days, freq="D")
        out.append(pd.DataFrame({
            "service_id": service, "sector": sector, "date": at.date,
            "demand": rng.poisson(np.resize(level, days)).astype(float)}))
    return pd.concat(out)


SPANS = benchmarks.Spans(train=("2022-01-01", "2023-01-01"), test=("2023-01-01", "2024-01-01"))


@pytest.fixture(scope="module")
def demand(spark):
    return spark.createDataFrame(seasonal(), SCHEMA).cache()


def numpy_fit(train, test, names, target, intercept):
    x, z = train[names].to_numpy(float), test[names].to_numpy(float)
    y = train[target].to_numpy(float)
    if not intercept:
        w = np.linalg.lstsq(x, y, rcond=1e-10)[0]
        return w, 0.0, np.maximum(z @ w, 0)
    mx, my = x.mean(0), y.mean()
    w = np.linalg.lstsq(x - mx, y - my, rcond=1e-10)[0]
    return w, my - mx @ w, np.maximum((z - mx) @ w + my, 0)


@pytest.mark.parametrize("intercept", [False, True])
@pytest.mark.parametrize("by_series", [False, True])
def test_linear_equals_numpy(spark, demand, by_series, intercept):
    names = features.linear_features(DAILY)
    train, test = [t.toPandas() for t in benchmarks.linear_rows(demand, SPANS, DAILY)]
    got = benchmarks.linear_forecast(demand, SPANS, DAILY, by_series, intercept).toPandas()
    models = benchmarks.linear_models(demand, SPANS, DAILY, by_series, intercept).toPandas()
    groups = [["service_id", "sector"]] if by_series else [lambda _: 0]
    keys = ["service_id", "sector", "date"]
    for key, part in test.groupby(groups[0]):
        fit_rows = train
        model = models.iloc[0]
        if by_series:
            fit_rows = train[(train.service_id == key[0]) & (train.sector == key[1])]
            model = models[(models.service_id == key[0]) & (models.sector == key[1])].iloc[0]
        assert model["rows"] == len(fit_rows)
        merged = part[keys].merge(got, on=keys)
        for h in features.HORIZONS:
            w, b, want = numpy_fit(fit_rows, part, names, features.ahead(h), intercept)
            assert np.allclose(merged[backtest.predicted(h, "linear")], want, atol=1e-6)
            assert np.allclose(model["weights"][h - 1], w, atol=1e-6)
            assert model["intercepts"][h - 1] == pytest.approx(b, abs=1e-5)


def test_linear_equals_spark_ml(spark, demand):
    train, test = benchmarks.linear_rows(demand, SPANS, DAILY)
    names = features.linear_features(DAILY)
    models = linear.fit(train, names, features.TARGETS, (), True)
    ours = linear.predict(test, models, names, features.HORIZONS, (), "linear")
    vectors = trees.assemble(train, names)
    other = LinearRegression(featuresCol=trees.VECTOR, labelCol="w_plus_2", regParam=0.0).fit(vectors)
    theirs = other.transform(trees.assemble(ours, names))
    gap = F.max(F.abs(F.greatest("prediction", F.lit(0.0)) - F.col("p_w_plus_2_linear")))
    assert theirs.agg(gap).first()[0] < 1e-4


def test_fewer_rows_than_features_gives_smallest_weights(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4, 6))
    y = rng.normal(size=4)
    frame = pd.DataFrame(x, columns=list("abcdef")).assign(y=y, k=1)
    model = linear.fit(spark.createDataFrame(frame), list("abcdef"), ["y"], ["k"]).first()
    assert np.allclose(model["weights"][0], np.linalg.lstsq(x, y, rcond=None)[0])


def test_series_without_training_rows_is_not_scored(spark, demand):
    late = seasonal(2, 200, ((9, "z"),))
    late["date"] = late["date"] + dt.timedelta(days=365)
    both = demand.unionByName(spark.createDataFrame(late, SCHEMA))
    forecast = benchmarks.linear_forecast(both, SPANS, DAILY, True)
    mine = forecast.filter("service_id = 9")
    assert mine.count() > 0
    assert mine.filter("p_w_plus_1_linear IS NOT NULL").count() == 0
    with_it = rows(benchmarks.linear_benchmark(both, SPANS, DAILY, True), "horizon")
    without = rows(benchmarks.linear_benchmark(demand, SPANS, DAILY, True), "horizon")
    assert np.allclose(with_it, without)


def test_series_without_test_rows_has_no_weights(spark, demand):
    early = spark.createDataFrame(seasonal(2, 200, ((9, "z"),)), SCHEMA)
    models = benchmarks.linear_models(demand.unionByName(early), SPANS, DAILY, True)
    assert {r["service_id"] for r in models.collect()} == {1, 2}


def test_empty_training_span_gives_no_forecast(spark, demand):
    spans = benchmarks.Spans(train=("2010-01-01", "2011-01-01"), test=SPANS.test)
    forecast = benchmarks.linear_forecast(demand, spans, DAILY)
    assert forecast.filter("p_w_plus_1_linear IS NOT NULL").count() == 0


def test_forecasts_are_not_negative(spark):
    df = spark.createDataFrame([(1.0, 2.0, -3.0)], "a double, b double, y double")
    model = linear.fit(df, ["a"], ["y"])
    got = linear.predict(df, model, ["a"], [1])
    assert got.first()["p_w_plus_1_linear"] == 0.0


def test_weight_table(spark, demand):
    models = benchmarks.linear_models(demand, SPANS, DAILY, True)
    names = features.linear_features(DAILY)
    table = linear.weight_table(models, names, features.TARGETS, DAILY.keys)
    assert table.count() == 3 * 5 * 19
    one = table.filter("service_id = 2 AND horizon = 'w_plus_3' AND feature = 'lag_2w'").first()
    model = models.filter("service_id = 2").first()
    assert one["weight"] == model["weights"][2][names.index("lag_2w")]


def test_solving_needs_no_package_on_workers():
    body = cloudpickle.dumps(linear.solver(["k"], 2, True))
    code = (
        "import sys, pickle; sys.path = [p for p in sys.path if 'repo' not in p]\n"
        "import pandas as pd\n"
        "f = pickle.loads(sys.stdin.buffer.read())\n"
        "m = [[3.0, 6.0, 0.0, 9.0], [6.0, 14.0, 0.0, 20.0], [0.0, 0.0, 0.0, 0.0]]\n"
        "out = next(f(iter([pd.DataFrame({'k': [1], 'moments': [m]})])))\n"
        "print(round(out['weights'][0][0][0], 6))"
    )
    done = subprocess.run([sys.executable, "-c", code], input=body, capture_output=True, cwd="/")
    assert done.stdout.strip() == b"1.0", done.stderr


def test_recursive_mean(spark):
    df = spark.createDataFrame([(9.0, 3.0, 6.0)], "demand double, w_minus_1 double, w_minus_2 double")
    r = backtest.with_recursive_mean(df).first()
    p = [r[backtest.predicted(h, "baseline")] for h in features.HORIZONS]
    assert p == pytest.approx([6.0, 6.0, 7.0, 7.0, 7.0])


def test_split_parts_are_disjoint_and_embargoed(spark, demand):
    a, b = backtest.split(demand, ("2022-01-01", "2022-07-01"), ("2022-07-01", "2023-01-01"))
    assert a.intersect(b).count() == 0
    assert a.agg(F.max("date")).first()[0] == dt.date(2022, 6, 30)
    c, d = backtest.split(
        demand, ("2022-01-01", "2022-07-01"), ("2022-07-01", "2023-01-01"), embargo_days=35)
    assert c.agg(F.max("date")).first()[0] == dt.date(2022, 5, 26)
    assert d.count() == b.count()


def test_reading_around_the_test_span_changes_nothing(spark, demand):
    span = ("2022-09-01", "2022-11-01")
    whole = features.with_offsets(demand, DAILY, back=(1, 2))
    whole = backtest.in_span(features.complete(whole, benchmarks.OFFSETS), span)
    want = backtest.score(backtest.with_recursive_mean(whole, DAILY), ["baseline"])
    got = benchmarks.recursive_mean_backtest(demand, span, DAILY)
    assert np.allclose([r[2:] for r in rows(got, "horizon")], [r[2:] for r in rows(want, "horizon")])


def test_scores_and_comparison(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 1.0), (3.0, 1.0, 3.0), (5.0, None, 99.0), (None, 1.0, 1.0)],
        "w_plus_1 double, p_w_plus_1_baseline double, p_w_plus_1_trees double")
    scores = backtest.score(df, ["baseline", "trees"], [1])
    got = {r["method"]: r[2:] for r in scores.collect()}
    assert got["baseline"] == pytest.approx((1.5, 2.5, 2.5 ** 0.5)) and got["trees"] == (0.0, 0.0, 0.0)
    assert all(r["rmse"] >= r["mae"] for r in scores.collect())
    wide = backtest.compare(scores, "baseline", ["trees"]).first()
    assert wide["diff_mae_trees"] == -1.5 and wide["mse_baseline"] == 2.5


def test_squared_trees_beat_the_mean(spark, demand):
    params = trees.TreeParams(maxIter=8, stepSize=0.3, maxDepth=3)
    train, test = benchmarks.linear_rows(demand, SPANS, DAILY)
    got = trees.forecast_squared(train, test, features.linear_features(DAILY), params, (1,))
    assert got.count() == test.count() and trees.VECTOR not in got.columns
    assert got.filter("p_w_plus_1_trees IS NULL OR p_w_plus_1_trees < 0").count() == 0
    center = train.agg(F.avg("w_plus_1")).first()[0]
    mae = got.agg(F.avg(F.abs(F.col("w_plus_1") - F.col("p_w_plus_1_trees")))).first()[0]
    naive = got.agg(F.avg(F.abs(F.col("w_plus_1") - F.lit(center)))).first()[0]
    assert mae < 0.8 * naive


def test_counts_beat_the_mean_and_repeat(spark, demand):
    train, test = benchmarks.tree_rows(demand, SPANS, DAILY)
    names = benchmarks.count_features(DAILY)
    got = [trees.forecast_counts(train, test, names, (1,)) for _ in range(2)]
    keys = ("service_id", "sector", "date")
    first, again = (rows(g.select(*keys, "p_w_plus_1_counts"), *keys) for g in got)
    assert len(first) == test.count() and all(r[3] > 0 for r in first)
    assert [r[3] for r in first] == pytest.approx([r[3] for r in again], rel=1e-6)
    center = train.agg(F.avg("w_plus_1")).first()[0]
    mae = got[0].agg(F.avg(F.abs(F.col("w_plus_1") - F.col("p_w_plus_1_counts")))).first()[0]
    naive = got[0].agg(F.avg(F.abs(F.col("w_plus_1") - F.lit(center)))).first()[0]
    assert mae < naive


def test_counts_find_group_means(spark):
    df = spark.createDataFrame([(float(g), float(y)) for g, ys in ((0, (1, 3)), (1, (8, 12))) for y in ys * 50],
                               "g double, w_plus_1 double")
    got = {r["g"]: r["p_w_plus_1_counts"] for r in trees.forecast_counts(df, df, ["g"], (1,)).collect()}
    assert got[0.0] == pytest.approx(2.0, rel=1e-6) and got[1.0] == pytest.approx(10.0, rel=1e-6)


def test_staged_and_full_fits_choose_the_same_round(spark):
    rng = np.random.default_rng(3)
    data = [(float(x), float(np.sin(x) + rng.normal(0, 0.5))) for x in rng.uniform(0, 6, 300)]
    frame = trees.assemble(spark.createDataFrame(data, "x double, y double"), ["x"])
    fit_rows, check = frame.filter("x < 3 OR x > 4"), frame
    params = trees.TreeParams(maxIter=24, stepSize=0.8, maxDepth=5, minInstancesPerNode=1)
    full = trees.squared_trees(params, "y").fit(fit_rows).evaluateEachIteration(check, "absolute")
    for patience in (2, 5):
        found = trees.staged(fit_rows, check, "y", params, patience)
        assert found.params.maxIter == trees.best_round(full, patience)
        cut = trees.squared_trees(found.params, "y").fit(fit_rows)
        assert cut.evaluateEachIteration(check, "absolute")[-1] == pytest.approx(full[found.params.maxIter - 1])
        assert found.mae == pytest.approx(trees.clipped_error(cut, check, "y"))
        assert found.fitted < 5 * (found.params.maxIter + patience)


def test_search_draws():
    a, b = trees.draws(10, seed=3), trees.draws(10, seed=3)
    assert a == b and len({tuple(d.items()) for d in a}) == 10
    for d in a:
        assert all(d[k] in v for k, v in trees.SEARCH_SPACE.items())
    assert len(trees.draws(99, space={"maxDepth": [1, 2], "stepSize": [0.1]})) == 2


def test_best_round():
    assert trees.best_round([3.0, 2.0, 2.5, 2.5, 1.0], patience=2) == 2
    assert trees.best_round([3.0, 2.0, 2.5, 2.5, 1.0], patience=100) == 5
    assert trees.best_round([1.0, 1.0], patience=5) == 1


def test_year_backtest(spark, demand):
    tried, figures = benchmarks.year_backtest(
        demand, ("2022-01-01", "2022-10-01"), ("2022-10-01", "2023-01-01"), SPANS.test, DAILY,
        candidates=2, patience=3, base=trees.TreeParams(maxIter=4))
    assert len(tried) == 2 and tried[0].mae <= tried[1].mae
    assert 1 <= tried[0].params.maxIter <= 4
    r = figures.first()
    assert r["rmse"] >= r["mae"] > 0 and r["rmse"] == pytest.approx(r["mse"] ** 0.5)


def test_three_way(spark, demand):
    got = benchmarks.three_way_benchmark(demand, SPANS, DAILY, (1, 5))
    assert [r["horizon"] for r in got.orderBy("horizon").collect()] == [1, 5]
    assert {"mae_baseline", "mae_linear", "mae_counts", "diff_mae_linear", "diff_mae_counts"} <= set(got.columns)


def test_dropping_before_lagging(spark, demand):
    """Rows without all offsets take no place when lags count rows."""
    gappy = demand.filter("NOT (service_id = 1 AND date = '2022-03-07')")
    after = benchmarks.tree_rows(gappy, SPANS, DAILY, drop_before_lag=False)
    before = benchmarks.tree_rows(gappy, SPANS, DAILY, drop_before_lag=True)
    assert before[0].count() < after[0].count()
