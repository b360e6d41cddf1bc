"""Trees on held-out rows: nodes of the kept models are walked row by row in plain Python."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotcast.grid import DAILY
from slotcast.operators import features, trees
from slotcast.operators.backtest import predicted
from slotcast.plans import benchmarks

SPANS = benchmarks.Spans(train=("2022-01-01", "2022-11-01"), test=("2022-11-01", "2023-02-01"))
SMALL = trees.TreeParams(maxIter=4, stepSize=0.3, maxDepth=3)


@pytest.fixture(scope="module")
def demand(spark):
    rng = np.random.default_rng(11)
    first = dt.date(2022, 1, 1)
    made = [
        (k, "ab"[k % 2], first + dt.timedelta(days=i),
         float(max(0, round(6 + 4 * np.sin(i / 7 * 2 * np.pi) + k + rng.normal(0, 2)))))
        for k in range(4) for i in range(430)
    ]
    return spark.createDataFrame(made, "service_id long, sector string, date date, demand double").cache()


class Walker:
    """A kept model as nodes and weights."""

    def __init__(self, spark, folder):
        self.nodes, self.weights = {}, {}
        for r in spark.read.parquet(f"{folder}/data").collect():
            self.nodes[r["treeID"], r["nodeData"]["id"]] = r["nodeData"]
        for tree, _, weight in spark.read.parquet(f"{folder}/treesMetadata").collect():
            self.weights[tree] = weight

    def __call__(self, x):
        total = 0.0
        for tree, weight in self.weights.items():
            node = self.nodes[tree, 0]
            while node["leftChild"] >= 0:
                split = node["split"]
                assert split["numCategories"] == -1
                left = x[split["featureIndex"]] <= split["leftCategoriesOrThreshold"][0]
                node = self.nodes[tree, node["leftChild" if left else "rightChild"]]
            total += weight * node["prediction"]
        return max(0.0, total)


def plain_errors(rows, walk, names, target):
    apart = [r[target] - walk([float(r[n]) for n in names]) for r in rows if all(r[n] is not None for n in names)]
    return sum(map(abs, apart)) / len(apart), sum(a * a for a in apart) / len(apart)


def test_errors_of_five_horizons(spark, demand, tmp_path):
    folder = f"file:{tmp_path}/models"
    table = benchmarks.tree_benchmark(demand, SPANS, DAILY, SMALL, folder=folder).collect()
    assert sorted(r["horizon"] for r in table) == [1, 2, 3, 4, 5]
    _, test = benchmarks.linear_rows(demand, SPANS, DAILY)
    rows, names = test.collect(), features.linear_features(DAILY)
    assert rows and min(r["date"] for r in rows) >= dt.date(2022, 11, 1)
    for r in table:
        target = features.ahead(r["horizon"])
        mae, mse = plain_errors(rows, Walker(spark, f"{folder}/{target}"), names, target)
        assert (r["mae_trees"], r["mse_trees"], r["rmse_trees"]) == pytest.approx((mae, mse, mse**0.5))
        guess = [np.mean([q["lag_1w"], q["lag_2w"], q["lag_3w"]]) for q in rows]
        assert r["mae_baseline"] == pytest.approx(np.mean([abs(q[target] - g) for q, g in zip(rows, guess)]))


def test_kept_models_need_no_second_fit(spark, demand, tmp_path):
    folder, targets = f"file:{tmp_path}/models", features.TARGETS[:2]
    train, test = benchmarks.linear_rows(demand, SPANS, DAILY)
    names, inputs = {t: f"p_{t}" for t in targets}, features.linear_features(DAILY)
    models = trees.fit_squared(train, inputs, targets, SMALL)
    trees.save_models(models, folder)
    trees.save_models(models, folder)
    keys = ("service_id", "sector", "date", *names.values())
    fresh, kept = (
        sorted(map(tuple, trees.with_forecasts(test, m, inputs, names).select(*keys).collect()))
        for m in (models, trees.load_models(folder, targets))
    )
    assert fresh == kept and len(fresh) == test.count()


def test_year_backtest_by_its_nodes(spark, demand, tmp_path):
    folder = f"file:{tmp_path}/year"
    spans = ("2022-01-01", "2022-08-01"), ("2022-08-01", "2022-11-01"), ("2022-11-01", "2023-02-01")
    tried, figures = benchmarks.year_backtest(
        demand, *spans, DAILY, candidates=2, patience=2, base=trees.TreeParams(maxIter=6), folder=folder)
    assert [c.mae for c in tried] == sorted(c.mae for c in tried)
    names = features.backtest_features(DAILY)
    held = benchmarks.in_span(
        features.complete(features.with_model_features(demand, DAILY), [*names, "demand"]), spans[2])
    walk = Walker(spark, f"{folder}/demand")
    assert len(walk.weights) == tried[0].params.maxIter
    meta = json.loads(spark.read.text(f"{folder}/demand/metadata").first()[0])["paramMap"]
    assert meta["maxDepth"] == tried[0].params.maxDepth and meta["stepSize"] == tried[0].params.stepSize
    mae, mse = plain_errors(held.collect(), walk, names, "demand")
    assert tuple(figures.first()) == pytest.approx((mae, mse, mse**0.5))


def test_candidates_are_ranked_by_clipped_errors(spark):
    """Rows whose forecasts lie below 0: the order of clipped errors is another one."""
    rng = np.random.default_rng(2)
    data = [(float(x), float(z), float(-30 * (x < 1) + 3 * z)) for x, z in zip(rng.uniform(0, 4, 400), rng.integers(0, 3, 400))]
    frame = spark.createDataFrame(data, "x double, z double, y double")
    check = frame.filter("x < 1.2").withColumn("y", F.greatest("y", F.lit(0.0)))
    space = {"minInstancesPerNode": [1, 150], "maxDepth": [2, 3]}
    base = trees.TreeParams(maxIter=1, subsamplingRate=1.0, featureSubsetStrategy=1.0)
    tried = trees.search(frame, check, ["x", "z"], "y", 4, 1, base, 1, space)
    clipped, raw = {}, {}
    for c in tried:
        model = trees.squared_trees(c.params, "y").fit(trees.assemble(frame, ["x", "z"]))
        rows = model.setPredictionCol("p").transform(trees.assemble(check, ["x", "z"])).select("y", "p").collect()
        clipped[c.params] = np.mean([abs(y - max(0.0, p)) for y, p in rows])
        raw[c.params] = np.mean([abs(y - p) for y, p in rows])
        assert c.mae == pytest.approx(clipped[c.params])
    order = [c.params for c in tried]
    assert order == sorted(order, key=clipped.get) and order != sorted(order, key=raw.get)


def test_three_way_with_trees(spark, demand, tmp_path):
    folder = f"file:{tmp_path}/three"
    table = benchmarks.three_way_benchmark(demand, SPANS, DAILY, (1, 4), trees=SMALL, folder=folder).collect()
    _, test = benchmarks.tree_rows(demand, SPANS, DAILY, True)
    rows, names = test.collect(), features.tree_features(DAILY)
    for r in table:
        target = features.ahead(r["horizon"])
        mae, mse = plain_errors(rows, Walker(spark, f"{folder}/{target}"), names, target)
        assert (r["mae_trees"], r["mse_trees"]) == pytest.approx((mae, mse))
        assert r["diff_mae_trees"] == pytest.approx(r["mae_trees"] - r["mae_baseline"])
        mean = np.mean([abs(q[target] - q[predicted(r["horizon"], "baseline")]) for q in rows])
        assert r["mae_baseline"] == pytest.approx(mean)
