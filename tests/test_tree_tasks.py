"""Tree fits in as many tasks as their rows ask for, on a panel that is worked out once."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from queries import QUERIES
from slotcast.grid import DAILY
from slotcast.operators import trees
from slotcast.operators.trees import Candidate, TreeParams
from slotcast.plans import benchmarks
from tests.test_oracle import SF


def test_partitions_follow_rows(spark):
    n = trees.ROWS_A_TASK
    for rows, parts, want in ((100, 64, 1), (0, 5, 1), (2 * n + 1, 64, 3), (4 * n, 2, 2)):
        with trees.kept(spark.range(rows, numPartitions=parts)) as held:
            assert held.rdd.getNumPartitions() == want and held.count() == rows


def test_year_backtest_works_its_panel_out_once(spark):
    """Three fits, two checks and a refit read the panel; its rows are made once."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(400)]
    rows = [(f"s{k}", "x", d, float((i * 7 + k * 3) % 11 + i % 7)) for k in range(2) for i, d in enumerate(days)]
    schema = "service_id string, sector string, date date, demand double"
    panel = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    tried, figures = benchmarks.year_backtest(
        panel, ("2020-01-01", "2020-09-01"), ("2020-09-01", "2020-11-01"), ("2020-11-01", "2021-02-01"),
        DAILY, candidates=2, patience=2, base=TreeParams(maxIter=2),
    )
    assert len(tried) == 2 and figures.first()["mae"] > 0
    assert made.value == len(rows)


def test_year_backtest_query_searches_as_published(spark, monkeypatch):
    """Ten candidates of up to 3,000 trees, each looked at until 100 trees bring nothing; fits stand in."""
    asked = []

    def staged(fit_rows, check, target, params, patience):
        asked.append((params.maxIter, patience, fit_rows.count(), check.count()))
        return Candidate(replace(params, maxIter=1), params.stepSize, 1)

    monkeypatch.setattr(trees, "staged", staged)
    found = QUERIES["year_backtest"](spark, SF).orderBy("place").collect()
    assert len(asked) == len(found) == 10 and [r["place"] for r in found] == list(range(1, 11))
    assert {a[:2] for a in asked} == {(3000, 100)}
    inputs = QUERIES["backtest_inputs"](spark, SF)
    whole = tuple(inputs.filter(f"date >= '{a}' AND date < '{b}'").count() for a, b in ((1995, 1998), (1998, 1999)))
    assert min(whole) > 0 and {a[2:] for a in asked} == {whole}
    assert found[0]["test_mae"] > 0 and all(r["test_mae"] is None for r in found[1:])


def test_no_fit_is_too_short_to_end_a_search(spark):
    """Where more trees only do harm, the search ends with its first fit and the cut model."""
    data = [(float(i % 13), float(i % 13)) for i in range(260)]
    frame = trees.assemble(spark.createDataFrame(data, "x double, y double"), ["x"])
    check = frame.withColumn("y", F.lit(6.0))
    params = TreeParams(maxIter=50, stepSize=0.5, maxDepth=1, subsamplingRate=1.0, featureSubsetStrategy=1.0)
    found = trees.staged(frame, check, "y", params, 3)
    assert found.params.maxIter <= 3 and found.fitted == 6 + found.params.maxIter
