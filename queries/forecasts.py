"""Features, baselines, linear models and trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from queries.least_squares_sql import least_squares_sql, product_sql
from queries.panels import (
    DAILY_DENSE_SQL,
    DAILY_SQL,
    HOURLY_DENSE_SQL,
    daily,
    daily_dense,
    hourly_dense,
    suppliers,
)
from queries.shape import plain
from slotcast.functions.checkpoints import checkpointed, work_folder
from slotcast.grid import DAILY, HOURLY, Grid
from slotcast.operators import backtest, chunks, codes, features, linear, smoothing, trees
from slotcast.operators.features import BACK, HORIZONS, TARGETS, WEEKLY_LAGS
from slotcast.plans import benchmarks

SPANS = benchmarks.Spans(train=("1995-01-01", "2000-01-01"), test=("2000-01-01", "2001-01-01"))
EARLY = benchmarks.Spans(
    train=("1995-01-01", "1999-07-01"), test=("2000-01-01", "2001-01-01"), embargo_days=35
)
# Settings of the registered tree query; the published ones are the defaults of
# the plan. All rows take part in every tree, so that forecasts of the training
# rows sum to their targets, which SQL can check.
BALANCED = trees.TreeParams(
    maxIter=20, stepSize=0.3, maxDepth=4, subsamplingRate=1.0, featureSubsetStrategy=1.0
)
# Candidates of one split each, on weekday and month, so that SQL can work them out.
STUMPS = {"stepSize": [round(0.05 * i, 2) for i in range(1, 11)], "maxDepth": [1]}

SERIES_KEYS = ["service_id", "sector", "date"]


def week_offsets(spark, sf):
    return plain(features.with_offsets(daily(spark, sf), DAILY))


def lag_features(spark, sf):
    rows = features.with_lags(hourly_dense(spark, sf), HOURLY)
    return plain(rows.select(
        *HOURLY.slot_columns, "demand", *features.WEEKLY_LAGS, *features.DAY_LAGS
    ))


def rolling_features(spark, sf):
    rows = features.with_lags(hourly_dense(spark, sf), HOURLY)
    return plain(rows.select(*HOURLY.slot_columns, *features.ROLLING))


def same_hour_means(spark, sf):
    rows = features.with_lags(hourly_dense(spark, sf), HOURLY)
    return plain(rows.select(*HOURLY.slot_columns, *features.SAME_HOUR))


# Rows of a chunk in the queries below: a few weeks, so that series of a month are cut.
CHUNK_ROWS = 700


def chunked_lags(spark, sf):
    """Lags and rolling means of series that are spread over chunks of rows."""
    rows = chunks.with_lags_in_chunks(hourly_dense(spark, sf), HOURLY, CHUNK_ROWS)
    return plain(rows.select(*HOURLY.slot_columns, "demand", *features.LAG_FEATURES))


def chunked_sparse_lags(spark, sf):
    """The same on a panel with gaps and undated rows: lags count rows across chunks."""
    rows = chunks.with_lags_in_chunks(undated(spark, sf), DAILY, 100)
    return plain(rows.filter(F.col("date").isNotNull()))


def chunked_moving_mean(spark, sf):
    """The mean of the last seven rows of each daily series, in chunks of rows."""
    return plain(chunks.moving_mean_in_chunks(daily(spark, sf), 7, DAILY, 50))


def exponential_means(spark, sf):
    """Exponentially weighted means of three spans, from pairs by chunk."""
    rows = smoothing.exponential_means(hourly_dense(spark, sf), size=100)
    return plain(rows.select(*HOURLY.slot_columns, *smoothing.SPANS))


def rolling_medians(spark, sf):
    """Medians of 24 and 168 rows that end one row before the one-week lag."""
    rows = smoothing.rolling_medians(hourly_dense(spark, sf))
    return plain(rows.select(*HOURLY.slot_columns, *smoothing.MEDIANS))


def sparse_lags(spark, sf):
    """Lags on a panel with gaps count rows."""
    return plain(features.with_lags(daily(spark, sf), DAILY))


def category_codes(spark, sf):
    rows = suppliers(spark, sf).select("service_id", "sector")
    return plain(codes.with_codes(rows, features.CODES))


def calendar_features(spark, sf):
    return plain(features.with_calendar(daily(spark, sf).select(*SERIES_KEYS), DAILY))


def baseline_backtest(spark, sf):
    return plain(benchmarks.recursive_mean_backtest(daily_dense(spark, sf), SPANS.test, DAILY))


def sparse_baseline(spark, sf):
    """Recursive mean on a panel with gaps: only rows with all offsets count."""
    panel = daily(spark, sf).groupBy("service_id", "date").agg(F.sum("demand").alias("demand"))
    grid = Grid(keys=("service_id",), hour=None)
    return plain(benchmarks.recursive_mean_backtest(panel, SPANS.test, grid))


def same_hour_backtest(spark, sf):
    return plain(benchmarks.same_hour_backtest(daily_dense(spark, sf), SPANS.test, DAILY))


def baseline_rows(spark, sf):
    """Recursive-mean forecasts row by row."""
    rows = features.with_offsets(daily_dense(spark, sf), DAILY, back=(1, 2))
    rows = features.complete(rows, benchmarks.OFFSETS)
    return plain(backtest.with_recursive_mean(rows, DAILY))


def split_rows(spark, sf):
    """Rows per span, with 35 days left out before the second one."""
    train, test = backtest.split(daily_dense(spark, sf), SPANS.train, SPANS.test, embargo_days=35)
    parts = [
        part.groupBy("service_id", "sector").agg(
            F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"),
            F.min("date").alias("first"), F.max("date").alias("last"),
        )
        for name, part in (("train", train), ("test", test))
    ]
    return plain(parts[0].unionByName(parts[1]))


def four_lag_weights(spark, sf):
    """Weights of the last four weeks, without intercept, rounded as published."""
    rows = features.with_features(daily_dense(spark, sf), DAILY)
    known = features.complete(rows, [*DAILY.keys, *WEEKLY_LAGS, *TARGETS])
    train = backtest.in_span(known, SPANS.train)
    models = linear.fit(train, WEEKLY_LAGS, TARGETS)
    return plain(linear.weight_table(models, WEEKLY_LAGS, TARGETS), 3)


# Training spans that end ever later, as the published ones do, and one that starts later.
CUTS = {
    "to 1998": ("1995-01-01", "1998-01-01"), "to mid 1999": ("1995-01-01", "1999-07-01"),
    "to 2000": ("1995-01-01", "2000-01-01"), "since 1998": ("1998-01-01", None),
}


def cut_weights(spark, sf):
    """Weights of the last four weeks of each series for four training spans, from one pass."""
    rows = features.with_features(daily_dense(spark, sf), DAILY)
    known = features.complete(rows, [*DAILY.keys, *WEEKLY_LAGS, *TARGETS])
    models = linear.fit_spans(known, CUTS, WEEKLY_LAGS, TARGETS, DAILY.keys)
    table = linear.weight_table(models, WEEKLY_LAGS, TARGETS, ["span", *DAILY.keys])
    return plain(table, 4)


def _linear(by_series, intercept):
    def query(spark, sf):
        return plain(benchmarks.linear_benchmark(
            daily_dense(spark, sf), SPANS, DAILY, by_series, intercept
        ), 5)

    return query


def linear_by_series_rows(spark, sf):
    rows = benchmarks.linear_forecast(daily_dense(spark, sf), SPANS, DAILY, True, False)
    names = [backtest.predicted(h, "linear") for h in HORIZONS]
    return plain(rows.select(*SERIES_KEYS, *names), 4)


def forecast_sample(spark, sf):
    """The first five forecasts in key order."""
    rows = benchmarks.linear_forecast(daily_dense(spark, sf), SPANS, DAILY)
    pairs = [c for h in HORIZONS for c in (features.ahead(h), backtest.predicted(h, "linear"))]
    columns = [*SERIES_KEYS, "demand", *[features.past(k) for k in BACK], "same_hour_mean_3w"]
    return plain(rows.orderBy(*SERIES_KEYS).limit(5).select(*columns, *pairs), 5)


def series_weights(spark, sf):
    models = benchmarks.linear_models(daily_dense(spark, sf), SPANS, DAILY, by_series=True)
    names = features.linear_features(DAILY)
    return plain(linear.weight_table(models, names, TARGETS, DAILY.keys), 5)


def top_weights(spark, sf):
    """Weights of the shared model, largest first within each horizon."""
    models = benchmarks.linear_models(daily_dense(spark, sf), SPANS, DAILY)
    table = linear.weight_table(models, features.linear_features(DAILY), TARGETS)
    return plain(table, 5).orderBy("horizon", F.desc("weight"))


def series_weights_intercept(spark, sf):
    """Weights and intercepts of each series."""
    models = benchmarks.linear_models(daily_dense(spark, sf), SPANS, DAILY, by_series=True, intercept=True)
    names = features.linear_features(DAILY)
    return plain(linear.weight_table(models, names, TARGETS, DAILY.keys, intercept=True), 4)


def top_weights_intercept(spark, sf):
    """Weights and intercept of the shared model."""
    models = benchmarks.linear_models(daily_dense(spark, sf), SPANS, DAILY, intercept=True)
    names = features.linear_features(DAILY)
    return plain(linear.weight_table(models, names, TARGETS, intercept=True), 4)


def gbt_forecast(spark, sf):
    """For each horizon the mean forecast of the training rows, before clipping,
    which a balanced fit makes the mean target, and the errors of the baseline."""
    train, test = benchmarks.linear_rows(daily_dense(spark, sf), SPANS, DAILY)
    names = features.linear_features(DAILY)
    fitted = trees.forecast_squared(train, train, names, BALANCED, clip=False)
    means = fitted.agg(*[F.avg(backtest.predicted(h, "trees")).alias(f"m{h}") for h in HORIZONS])
    rows = means.select(F.inline(F.array(*[
        F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"m{h}").alias("train_mean")) for h in HORIZONS
    ])))
    errors = backtest.score(backtest.with_same_hour_mean(test), ["baseline"])
    return plain(rows.join(errors, "horizon").drop("method"), 5)


def poisson_forecast(spark, sf):
    """For each horizon and input the mean of input times forecast over the
    training rows. The likelihood is highest where it is that of input times
    target, which SQL can check."""
    train, _ = benchmarks.linear_rows(daily_dense(spark, sf), SPANS, DAILY)
    fitted = trees.forecast_counts(train, train, INDEPENDENT)
    inputs = {"intercept": F.lit(1.0), **{x: F.col(x) for x in INDEPENDENT}}
    names = [(h, x) for h in HORIZONS for x in inputs]
    one = fitted.agg(*[
        F.avg(inputs[x] * F.col(backtest.predicted(h, "counts"))).alias(f"{h}_{x}") for h, x in names
    ])
    return plain(one.select(F.inline(F.array(*[
        F.struct(F.lit(h).cast("long").alias("horizon"), F.lit(x).alias("input"), F.col(f"{h}_{x}").alias("mean"))
        for h, x in names
    ]))), 3)


def model_comparison(spark, sf):
    """Errors of the recursive mean and of least squares on four weeks, and the
    mean forecast of the counts model over its training rows."""
    train, test = benchmarks.tree_rows(daily_dense(spark, sf), EARLY, DAILY, True)
    models = linear.fit(train, WEEKLY_LAGS, TARGETS)
    forecast = linear.predict(test, models, WEEKLY_LAGS, HORIZONS)
    errors = backtest.compare(backtest.score(forecast, ["baseline", "linear"]), "baseline", ["linear"])
    fitted = trees.forecast_counts(train, train, COUNT_INPUTS)
    one = fitted.agg(*[F.avg(backtest.predicted(h, "counts")).alias(f"m{h}") for h in HORIZONS])
    means = one.select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"m{h}").alias("counts_train_mean")) for h in HORIZONS
    ])))
    return plain(errors.join(means, "horizon"), 4)


def tree_errors(spark, sf):
    """Errors on the test rows of the three-week mean and of trees, five horizons.

    The models are kept in the shared folder and read back for the forecasts. Of
    the published 300 trees 20 are fitted here, at a higher rate (``BALANCED``).
    """
    with work_folder(spark) as folder:
        errors = benchmarks.tree_benchmark(daily_dense(spark, sf), SPANS, DAILY, BALANCED, folder=folder)
        return checkpointed(plain(errors, 5))


def three_way_trees(spark, sf):
    """Errors on the test rows of the recursive mean, least squares on four weeks,
    the counts model and trees on all inputs."""
    with work_folder(spark) as folder:
        errors = benchmarks.three_way_benchmark(
            daily_dense(spark, sf), EARLY, DAILY, features=COUNT_INPUTS, trees=BALANCED, folder=folder
        )
        return checkpointed(plain(errors, 4))


# Spans of the year backtest below, as long as the published ones; the size of its search is the
# published one, the default of the plan.
YEARS = {
    "train": ("1995-01-01", "1998-01-01"), "validation": ("1998-01-01", "1999-01-01"), "test": ("1999-01-01", "2000-01-01"),
}


def year_backtest(spark, sf):
    """The candidates of a search over the published space with early stop, best
    first, and the errors of the refitted best one in the year after."""
    with work_folder(spark) as folder:
        tried, figures = benchmarks.year_backtest(daily_dense(spark, sf), **YEARS, grid=DAILY, folder=folder)
        best = figures.select(F.lit(1).cast("long").alias("place"), *[F.col(c).alias(f"test_{c}") for c in figures.columns])
        return checkpointed(plain(trees.candidate_table(spark, tried).join(best, "place", "left"), 5))


def tree_inputs(spark, sf):
    """The inputs of the weekly-ahead tree models, row by row."""
    rows = features.with_model_features(hourly_dense(spark, sf), HOURLY)
    return plain(features.complete(rows, features.tree_features(HOURLY)).select(
        *HOURLY.keys, HOURLY.date, *features.tree_features(HOURLY)
    ))


def backtest_inputs(spark, sf):
    """The inputs of the year-ahead backtest, row by row."""
    rows = features.with_model_features(daily_dense(spark, sf), DAILY)
    return plain(features.complete(rows, features.backtest_features(DAILY)).select(
        *DAILY.keys, DAILY.date, *features.backtest_features(DAILY)
    ))


def poisson_errors(spark, sf):
    """Errors on the test rows of the recursive mean and of the counts model."""
    panel = daily_dense(spark, sf)
    return plain(benchmarks.count_benchmark(panel, EARLY, DAILY, features=COUNT_INPUTS), 4)


def three_way_errors(spark, sf):
    """Errors on the test rows of the recursive mean, least squares on four weeks
    and the counts model."""
    panel = daily_dense(spark, sf)
    return plain(benchmarks.three_way_benchmark(panel, EARLY, DAILY, features=COUNT_INPUTS), 4)


def gbt_search(spark, sf):
    """The table of ten candidates of a search, each of a single split."""
    rows = features.with_calendar(daily_dense(spark, sf), DAILY)
    fit_rows, check = backtest.split(rows, ("1995-01-01", "1999-01-01"), ("1999-01-01", "2000-01-01"))
    base = trees.TreeParams(maxIter=1, subsamplingRate=1.0, featureSubsetStrategy=1.0)
    tried = trees.search(
        fit_rows, check, ["weekday", "month"], "demand", candidates=10, patience=2, base=base, space=STUMPS
    )
    table = trees.candidate_table(spark, tried)
    return plain(table.select("stepSize", "maxDepth", "maxIter", "mae", "fitted"), 5)


def undated_offsets(spark, sf):
    """Week offsets where some rows have no date."""
    return plain(features.with_offsets(undated(spark, sf), DAILY))


def undated_lags(spark, sf):
    """Lags of the dated rows where others have no date."""
    rows = features.with_lags(undated(spark, sf), DAILY)
    return plain(rows.filter(F.col("date").isNotNull()))


def undated(spark, sf):
    known = F.when(F.day("date") != 13, F.col("date"))
    return daily(spark, sf).withColumn("date", known)


def offsets_sql(panel: str, back, forward) -> str:
    joins, columns = [], []
    for name, days in [(f"w_minus_{k}", -7 * k) for k in back] + [
        (f"w_plus_{k}", 7 * k) for k in forward
    ]:
        joins.append(
            f"LEFT JOIN {panel} {name} ON {name}.service_id = x.service_id "
            f"AND {name}.sector = x.sector AND {name}.date = x.date + ({days})"
        )
        columns.append(f"{name}.demand AS {name}")
    return f"SELECT x.*, {', '.join(columns)} FROM {panel} x {' '.join(joins)}"


def lags_sql(panel: str, order: str, day: int) -> str:
    week = 7 * day
    spec = "PARTITION BY service_id, sector ORDER BY " + order
    columns = [f"lag(demand, {k * week}) OVER ({spec}) AS lag_{k}w" for k in (1, 2, 3, 4)]
    columns += [f"lag(demand, {week + d * day}) OVER ({spec}) AS lag_{24 * d}h" for d in (1, 2, 3)]
    for n in (3, 6, 24):
        frame = f"OVER ({spec} ROWS BETWEEN {week + n} PRECEDING AND {week + 1} PRECEDING)"
        columns.append(
            f"CASE WHEN count(demand) {frame} = {n} THEN avg(demand) {frame} END AS roll_mean_{n}h"
        )
    return f"SELECT *, {', '.join(columns)} FROM {panel}"


def mean_sql(*names: str) -> str:
    return f"list_avg([{', '.join(names)}])"


SAME_HOUR_SQL = f"""{mean_sql('lag_1w', 'lag_2w')} AS same_hour_mean_2w,
    {mean_sql('lag_1w', 'lag_2w', 'lag_3w')} AS same_hour_mean_3w,
    {mean_sql('lag_1w', 'lag_2w', 'lag_3w', 'lag_4w')} AS same_hour_mean_4w,
    0.4 * lag_1w + 0.3 * lag_2w + 0.2 * lag_3w + 0.1 * lag_4w AS same_hour_wavg_4w"""


def recursive_sql(rows: str) -> str:
    p = [f"p_w_plus_{h}_baseline" for h in HORIZONS]
    return f"""
    r1 AS (SELECT *, (demand + w_minus_1 + w_minus_2) / 3 AS {p[0]} FROM {rows}),
    r2 AS (SELECT *, (demand + w_minus_1 + {p[0]}) / 3 AS {p[1]} FROM r1),
    r3 AS (SELECT *, (demand + {p[0]} + {p[1]}) / 3 AS {p[2]} FROM r2),
    r4 AS (SELECT *, (demand + {p[0]} + {p[1]} + {p[2]}) / 4 AS {p[3]} FROM r3),
    r5 AS (SELECT *, (demand + {p[0]} + {p[1]} + {p[2]} + {p[3]}) / 5 AS {p[4]} FROM r4)"""


def errors_sql(rows: str, methods: dict[str, str]) -> str:
    """Long error table; a method maps to its forecast with {h} for the horizon."""
    parts = [
        f"SELECT {h}::BIGINT AS horizon, '{m}' AS method, avg(abs(w_plus_{h} - {p.format(h=h)})) AS mae,"
        f" avg((w_plus_{h} - {p.format(h=h)}) ** 2) AS mse FROM {rows}"
        for h in HORIZONS
        for m, p in methods.items()
    ]
    return "er AS (" + " UNION ALL ".join(parts) + ")"


SCORES_SQL = """SELECT horizon, method, round(mae, 6) AS mae, round(mse, 6) AS mse,
    round(sqrt(mse), 6) AS rmse FROM er"""
COMPARE_SQL = "SELECT a.horizon, " + ", ".join(
    f"round({t}.{e}, 5) AS {k}_{m}"
    for t, m in (("a", "baseline"), ("b", "linear"))
    for k, e in (("mae", "mae"), ("mse", "mse"))
) + """, round(sqrt(a.mse), 5) AS rmse_baseline, round(sqrt(b.mse), 5) AS rmse_linear,
    round(b.mae - a.mae, 5) AS diff_mae_linear, round(b.mse - a.mse, 5) AS diff_mse_linear,
    round(sqrt(b.mse) - sqrt(a.mse), 5) AS diff_rmse_linear
    FROM er a JOIN er b USING (horizon) WHERE a.method = 'baseline' AND b.method = 'linear'"""

TEST_SQL = "date >= DATE '2000-01-01' AND date < DATE '2001-01-01'"
TRAIN_SQL = "date >= DATE '1995-01-01' AND date < DATE '2000-01-01'"
HOURLY_LAGS = f"WITH {HOURLY_DENSE_SQL}, k AS ({lags_sql('hd', 'date, hour', 24)})"
SLOT_SQL = "service_id, sector, CAST(date AS VARCHAR) AS date, CAST(hour AS BIGINT) AS hour"

# Inputs of the linear models that do not depend on each other on a daily grid
# without gaps; the forecasts are the same as with all nineteen.
INDEPENDENT = [
    "demand", "lag_1w", "lag_2w", "lag_3w", "lag_4w", "lag_24h", "lag_48h", "lag_72h",
    "roll_mean_6h", "roll_mean_24h",
]
# Inputs of the counts model of the comparison.
COUNT_INPUTS = ["lag_1w", "lag_2w", "lag_3w", "lag_4w", "lag_24h", "weekday", "month"]
FEATURES_SQL = f"""{DAILY_DENSE_SQL},
    o AS ({offsets_sql('dd', BACK, HORIZONS)}),
    k AS ({lags_sql('o', 'date', 1)}),
    k2 AS (SELECT *, {SAME_HOUR_SQL} FROM k),
    c AS (SELECT * FROM k2 WHERE {' IS NOT NULL AND '.join(
        [*INDEPENDENT, 'w_minus_1', 'w_minus_2', 'w_minus_3', 'w_minus_4', *TARGETS])} IS NOT NULL),
    tr AS (SELECT * FROM c WHERE {TRAIN_SQL}),
    te AS (SELECT * FROM c WHERE {TEST_SQL})"""


def linear_sql(by_series: bool, intercept: bool) -> str:
    x = [*INDEPENDENT, *(["1.0"] if intercept else [])]
    keys = ["service_id", "sector"] if by_series else []
    join = "JOIN ls USING (service_id, sector)" if by_series else ", ls"
    forecasts = ", ".join(
        f"{product_sql(x, h - 1)} AS p_w_plus_{h}_linear" for h in HORIZONS
    )
    return f"""WITH {FEATURES_SQL},
    {least_squares_sql('tr', x, TARGETS, keys)},
    f AS (SELECT te.*, {forecasts} FROM te {join})"""


def expressed(feature: str) -> dict[str, float]:
    """A linear input in terms of the independent ones."""
    if feature.startswith("w_minus_"):
        return {f"lag_{feature[-1]}w": 1.0}
    if feature == "roll_mean_3h":
        return dict.fromkeys(features.DAY_LAGS, 1 / 3)
    if feature.startswith("same_hour_mean_"):
        weeks = int(feature[-2])
        return dict.fromkeys(WEEKLY_LAGS[:weeks], 1 / weeks)
    return features.WEEK_WEIGHTS if feature == "same_hour_wavg_4w" else {feature: 1.0}


def weights_sql(keys, intercept: bool = False) -> str:
    """Weights of all nineteen inputs. Of all weights that give the same
    forecasts as those of the independent inputs, w = D' (D D')^-1 b is the
    shortest, where D holds the inputs in terms of the independent ones."""
    names = features.linear_features(DAILY)
    d = np.array([[expressed(f).get(i, 0.0) for f in names] for i in INDEPENDENT])
    shortest = d.T @ np.linalg.inv(d @ d.T)
    parts = []
    for t, target in enumerate(TARGETS):
        for f, line in zip(names, shortest):
            total = " + ".join(f"{c!r}::DOUBLE * w_{t}_{i}" for i, c in enumerate(line.tolist()) if c)
            parts.append(
                f"SELECT {''.join(f'{k}, ' for k in keys)}'{target}' AS horizon, "
                f"'{f}' AS feature, round({total}, {4 if intercept else 5}) AS weight FROM ls"
            )
        if intercept:
            parts.append(
                f"SELECT {''.join(f'{k}, ' for k in keys)}'{target}' AS horizon, "
                f"'intercept' AS feature, round(w_{t}_{len(INDEPENDENT)}, 4) AS weight FROM ls"
            )
    inputs = [*INDEPENDENT, "1.0"] if intercept else INDEPENDENT
    return f"WITH {FEATURES_SQL}, {least_squares_sql('tr', inputs, TARGETS, keys)} " + (
        " UNION ALL ".join(parts)
    )


def benchmark_sql(by_series: bool, intercept: bool) -> str:
    methods = {"baseline": "same_hour_mean_3w", "linear": "p_w_plus_{h}_linear"}
    return f"{linear_sql(by_series, intercept)}, {errors_sql('f', methods)} {COMPARE_SQL}"


def ewm_sql(span: int) -> str:
    """The weighted mean written out: every value times the weight it has left."""
    a = f"(2::DOUBLE / {span + 1})"
    window = "(PARTITION BY service_id, sector ORDER BY date, hour)"
    return (
        f"pow(1 - {a}, i) * sum(CASE WHEN i = 0 THEN demand ELSE {a} * demand / pow(1 - {a}, i) END) OVER {window}"
    )


def median_sql(rows: int) -> str:
    frame = (
        "(PARTITION BY service_id, sector ORDER BY date, hour "
        f"ROWS BETWEEN {168 + rows} PRECEDING AND 169 PRECEDING)"
    )
    return f"CASE WHEN count(demand) OVER {frame} = {rows} THEN median(demand) OVER {frame} END"


def cut_sql() -> str:
    """One fit per span, each over its own rows."""
    parts, keys = [], ["service_id", "sector"]
    for name, (lo, hi) in CUTS.items():
        where = " AND ".join([f"date >= DATE '{lo}'"] + [f"date < DATE '{hi}'"] * (hi is not None))
        weights = " UNION ALL ".join(
            f"SELECT '{name}' AS span, service_id, sector, 'w_plus_{t + 1}' AS horizon, '{f}' AS feature, "
            f"round(w_{t}_{i}, 4) AS weight FROM ls" for t in range(5) for i, f in enumerate(WEEKLY_LAGS)
        )
        parts.append(f"""SELECT * FROM (WITH t4 AS (SELECT * FROM k2 WHERE {where}
          AND {' IS NOT NULL AND '.join([*WEEKLY_LAGS, *TARGETS])} IS NOT NULL),
        {least_squares_sql('t4', WEEKLY_LAGS, TARGETS, keys)} {weights})""")
    return f"WITH {FEATURES_SQL} " + " UNION ALL ".join(parts)


DATE_SQL = "CAST(date AS VARCHAR) AS date"

ORACLES = {
    "week_offsets": f"""WITH {DAILY_SQL}, o AS ({offsets_sql('d', BACK, HORIZONS)})
    SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM o""",
    "lag_features": f"""{HOURLY_LAGS} SELECT {SLOT_SQL}, demand, lag_1w, lag_2w, lag_3w, lag_4w,
    lag_24h, lag_48h, lag_72h FROM k""",
    "rolling_features": f"""{HOURLY_LAGS} SELECT {SLOT_SQL}, round(roll_mean_3h, 6) AS roll_mean_3h,
    round(roll_mean_6h, 6) AS roll_mean_6h, round(roll_mean_24h, 6) AS roll_mean_24h FROM k""",
    "chunked_lags": f"""{HOURLY_LAGS}, s AS (SELECT *, {SAME_HOUR_SQL} FROM k)
    SELECT {SLOT_SQL}, demand, {", ".join(f"round({c}, 6) AS {c}" for c in features.LAG_FEATURES)} FROM s""",
    "chunked_moving_mean": f"""WITH {DAILY_SQL}
    SELECT service_id, sector, CAST(date AS VARCHAR) AS date, demand, round(avg(demand) OVER (
      PARTITION BY service_id, sector ORDER BY d.date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_mean
    FROM d""",
    "exponential_means": f"""WITH {HOURLY_DENSE_SQL},
    p AS (SELECT *, row_number() OVER s - 1 AS i FROM hd WINDOW s AS (PARTITION BY service_id, sector ORDER BY date, hour)),
    e AS (SELECT *, {", ".join(f"{ewm_sql(n)} AS {name}" for name, n in smoothing.SPANS.items())} FROM p)
    SELECT {SLOT_SQL}, {", ".join(f"round(lag({name}, 169) OVER s, 6) AS {name}" for name in smoothing.SPANS)}
    FROM e WINDOW s AS (PARTITION BY service_id, sector ORDER BY e.date, e.hour)""",
    "rolling_medians": f"""WITH {HOURLY_DENSE_SQL},
    m AS (SELECT *, {", ".join(f"{median_sql(n)} AS {name}" for name, n in smoothing.MEDIANS.items())} FROM hd)
    SELECT {SLOT_SQL}, {", ".join(f"round({name}, 6) AS {name}" for name in smoothing.MEDIANS)} FROM m""",
    "same_hour_means": f"""{HOURLY_LAGS}, s AS (SELECT *, {SAME_HOUR_SQL} FROM k)
    SELECT {SLOT_SQL}, {", ".join(f"round({c}, 6) AS {c}" for c in features.SAME_HOUR)} FROM s""",
    "sparse_lags": f"""WITH {DAILY_SQL}, k AS ({lags_sql('d', 'date', 1)}),
    s AS (SELECT *, {SAME_HOUR_SQL} FROM k)
    SELECT service_id, sector, {DATE_SQL}, demand,
    {", ".join(f"round({c}, 6) AS {c}" for c in features.LAG_FEATURES)} FROM s""",
    "category_codes": """
    SELECT s_suppkey AS service_id, n_name AS sector,
           dense_rank() OVER (ORDER BY s_suppkey) - 1 AS service_code,
           dense_rank() OVER (ORDER BY n_name) - 1 AS sector_code
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "calendar_features": f"""WITH {DAILY_SQL}
    SELECT service_id, sector, {DATE_SQL}, isodow(date) - 1 AS weekday, month(date) AS month,
           day(date) AS day, week(date) AS weekofyear, dayofyear(date) AS dayofyear,
           quarter(date) AS quarter,
           round(sin(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS weekday_sin,
           round(cos(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS weekday_cos FROM d""",
    "baseline_backtest": f"""WITH {DAILY_DENSE_SQL},
    o AS ({offsets_sql('dd', (1, 2), HORIZONS)}),
    c AS (SELECT * FROM o WHERE {TEST_SQL} AND {' IS NOT NULL AND '.join(benchmarks.OFFSETS)} IS NOT NULL),
    {recursive_sql('c')}, {errors_sql('r5', {'baseline': 'p_w_plus_{h}_baseline'})} {SCORES_SQL}""",
    "sparse_baseline": f"""WITH {DAILY_SQL},
    g AS (SELECT service_id, '' AS sector, date, sum(demand) AS demand FROM d GROUP BY ALL),
    o AS ({offsets_sql('g', (1, 2), HORIZONS)}),
    c AS (SELECT * FROM o WHERE {TEST_SQL} AND {' IS NOT NULL AND '.join(benchmarks.OFFSETS)} IS NOT NULL),
    {recursive_sql('c')}, {errors_sql('r5', {'baseline': 'p_w_plus_{h}_baseline'})} {SCORES_SQL}""",
    "same_hour_backtest": f"""WITH {FEATURES_SQL},
    {errors_sql('te', {'baseline': 'same_hour_mean_3w'})} {SCORES_SQL}""",
    "baseline_rows": f"""WITH {DAILY_DENSE_SQL},
    o AS (SELECT *, lag(demand, 7) OVER s AS w_minus_1, lag(demand, 14) OVER s AS w_minus_2,
      {", ".join(f"lead(demand, {7 * h}) OVER s AS w_plus_{h}" for h in HORIZONS)}
      FROM dd WINDOW s AS (PARTITION BY service_id, sector ORDER BY dd.date)),
    c AS MATERIALIZED (SELECT * FROM o WHERE {' IS NOT NULL AND '.join(benchmarks.OFFSETS)} IS NOT NULL),
    {recursive_sql('c')}
    SELECT service_id, sector, {DATE_SQL}, demand, {', '.join(benchmarks.OFFSETS)},
    {", ".join(f"round(p_w_plus_{h}_baseline, 6) AS p_w_plus_{h}_baseline" for h in HORIZONS)} FROM r5""",
    "split_rows": f"""WITH {DAILY_DENSE_SQL},
    p AS (SELECT *, CASE WHEN {TRAIN_SQL} AND date < DATE '2000-01-01' - 35 THEN 'train'
                         WHEN {TEST_SQL} THEN 'test' END AS part FROM dd)
    SELECT service_id, sector, part, count(*) AS rows, CAST(min(date) AS VARCHAR) AS "first",
           CAST(max(date) AS VARCHAR) AS "last"
    FROM p WHERE part IS NOT NULL GROUP BY service_id, sector, part""",
    "four_lag_weights": f"""WITH {FEATURES_SQL},
    t4 AS (SELECT * FROM k2 WHERE {TRAIN_SQL} AND {' IS NOT NULL AND '.join([*WEEKLY_LAGS, *TARGETS])} IS NOT NULL),
    {least_squares_sql('t4', WEEKLY_LAGS, TARGETS)}
    SELECT * FROM (""" + " UNION ALL ".join(
        f"SELECT 'w_plus_{t + 1}' AS horizon, '{f}' AS feature, round(w_{t}_{i}, 3) AS weight FROM ls"
        for t in range(5)
        for i, f in enumerate(WEEKLY_LAGS)
    ) + ")",
    "linear_global": benchmark_sql(False, False),
    "linear_global_intercept": benchmark_sql(False, True),
    "linear_by_series": benchmark_sql(True, False),
    "linear_by_series_intercept": benchmark_sql(True, True),
    "linear_by_series_rows": f"""{linear_sql(True, False)}
    SELECT service_id, sector, {DATE_SQL},
    {", ".join(f"round(p_w_plus_{h}_linear, 4) AS p_w_plus_{h}_linear" for h in HORIZONS)} FROM f""",
    "series_weights": weights_sql(["service_id", "sector"]),
    "top_weights": weights_sql([]),
    "series_weights_intercept": weights_sql(["service_id", "sector"], True),
    "top_weights_intercept": weights_sql([], True),
    "forecast_sample": f"""{linear_sql(False, False)}
    SELECT service_id, sector, {DATE_SQL}, demand, w_minus_1, w_minus_2, w_minus_3, w_minus_4,
    round(same_hour_mean_3w, 5) AS same_hour_mean_3w,
    {", ".join(f"w_plus_{h}, round(p_w_plus_{h}_linear, 5) AS p_w_plus_{h}_linear" for h in HORIZONS)}
    FROM f ORDER BY service_id, sector, f.date LIMIT 5""",
}

UNDATED_SQL = f"""{DAILY_SQL},
    ud AS (SELECT * REPLACE (CASE WHEN day(date) <> 13 THEN date END AS date) FROM d)"""
STUMP_SIDES = [("isodow(date) - 1", k) for k in range(6)] + [("month(date)", k) for k in range(1, 12)]
COUNT_ROWS_SQL = f"""{DAILY_DENSE_SQL},
    o AS ({offsets_sql('dd', (1, 2), HORIZONS)}),
    c0 AS (SELECT * FROM o WHERE {' IS NOT NULL AND '.join(benchmarks.OFFSETS)} IS NOT NULL),
    k AS ({lags_sql('c0', 'date', 1)}),
    c AS (SELECT * FROM k WHERE {' IS NOT NULL AND '.join(
        [*features.WEEKLY_LAGS, *features.DAY_LAGS, *features.ROLLING])} IS NOT NULL),
    tr AS (SELECT * FROM c WHERE date >= DATE '1995-01-01' AND date < DATE '1999-07-01' - 35),
    te AS (SELECT * FROM c WHERE {TEST_SQL})"""
four_lag = ", ".join(f"{product_sql(WEEKLY_LAGS, h - 1)} AS p_w_plus_{h}_linear" for h in HORIZONS)

CODES_SQL = """dense_rank() OVER (ORDER BY service_id) - 1 AS service_code,
    dense_rank() OVER (ORDER BY sector) - 1 AS sector_code"""
CALENDAR_SQL = """isodow(date) - 1 AS weekday, month(date) AS month, day(date) AS day, week(date) AS weekofyear,
    dayofyear(date) AS dayofyear, quarter(date) AS quarter,
    round(sin(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS weekday_sin,
    round(cos(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS weekday_cos"""


def inputs_sql(panel: str, dense: str, order: str, grid: Grid, names: list[str]) -> str:
    shown = [f"round({c}, 6) AS {c}" if c in features.LAG_FEATURES else c for c in names]
    shown = ["CAST(hour AS BIGINT) AS hour" if c == "hour" else c for c in shown]
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*features.WEEKLY_LAGS, *features.DAY_LAGS, *features.ROLLING])
    return f"""WITH {dense}, k AS ({lags_sql(panel, order, grid.day)}),
    s AS (SELECT *, {SAME_HOUR_SQL}, {CODES_SQL}, {CALENDAR_SQL} FROM k)
    SELECT service_id, sector, {DATE_SQL}, {", ".join(shown)} FROM s WHERE {known}"""


ORACLES |= {
    "tree_inputs": inputs_sql("hd", HOURLY_DENSE_SQL, "date, hour", HOURLY, features.tree_features(HOURLY)),
    "backtest_inputs": inputs_sql("dd", DAILY_DENSE_SQL, "date", DAILY, features.backtest_features(DAILY)),
    "cut_weights": cut_sql(),
    "chunked_sparse_lags": f"""WITH {UNDATED_SQL}, k AS ({lags_sql('ud', 'date NULLS LAST', 1)}),
    s AS (SELECT *, {SAME_HOUR_SQL} FROM k)
    SELECT service_id, sector, {DATE_SQL}, demand,
    {", ".join(f"round({c}, 6) AS {c}" for c in features.LAG_FEATURES)} FROM s WHERE date IS NOT NULL""",
    "undated_offsets": f"""WITH {UNDATED_SQL}, o AS ({offsets_sql('ud', BACK, HORIZONS)})
    SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM o""",
    "undated_lags": f"""WITH {UNDATED_SQL}, k AS ({lags_sql('ud', 'date NULLS LAST', 1)}),
    s AS (SELECT *, {SAME_HOUR_SQL} FROM k)
    SELECT service_id, sector, {DATE_SQL}, demand,
    {", ".join(f"round({c}, 6) AS {c}" for c in features.LAG_FEATURES)} FROM s WHERE date IS NOT NULL""",
    "gbt_forecast": f"""WITH {FEATURES_SQL},
    {errors_sql('te', {'baseline': 'same_hour_mean_3w'})},
    m AS (""" + " UNION ALL ".join(
        f"SELECT {h}::BIGINT AS horizon, avg(w_plus_{h}) AS train_mean FROM tr" for h in HORIZONS
    ) + """)
    SELECT horizon, round(train_mean, 5) AS train_mean, round(mae, 5) AS mae, round(mse, 5) AS mse,
           round(sqrt(mse), 5) AS rmse FROM m JOIN er USING (horizon)""",
    "poisson_forecast": f"WITH {FEATURES_SQL} " + " UNION ALL ".join(
        f"SELECT {h}::BIGINT AS horizon, '{x}' AS input, round(avg({'1.0' if x == 'intercept' else x} * w_plus_{h}), 3) AS mean FROM tr"
        for h in HORIZONS for x in ["intercept", *INDEPENDENT]
    ),
    "model_comparison": f"""WITH {COUNT_ROWS_SQL},
    {least_squares_sql('tr', WEEKLY_LAGS, TARGETS)},
    {recursive_sql('te')},
    f AS (SELECT r5.*, {four_lag} FROM r5, ls),
    {errors_sql('f', {'baseline': 'p_w_plus_{h}_baseline', 'linear': 'p_w_plus_{h}_linear'})},
    cmp AS ({COMPARE_SQL.replace(', 5)', ', 4)')}),
    m AS (""" + " UNION ALL ".join(
        f"SELECT {h}::BIGINT AS horizon, round(avg(w_plus_{h}), 4) AS counts_train_mean FROM tr" for h in HORIZONS
    ) + """)
    SELECT cmp.*, counts_train_mean FROM cmp JOIN m USING (horizon)""",
    "gbt_search": f"""WITH {DAILY_DENSE_SQL},
    a AS (SELECT * FROM dd WHERE date >= DATE '1995-01-01' AND date < DATE '1999-01-01'),
    b AS (SELECT * FROM dd WHERE date >= DATE '1999-01-01' AND date < DATE '2000-01-01'),
    s AS (""" + " UNION ALL ".join(
        f"SELECT {i} AS i, avg(demand) FILTER ({x} <= {k}) AS l, avg(demand) FILTER ({x} > {k}) AS r, "
        f"count(*) FILTER ({x} <= {k}) AS n, count(*) FILTER ({x} > {k}) AS m FROM a"
        for i, (x, k) in enumerate(STUMP_SIDES)
    ) + f"""),
    best AS (SELECT * FROM s ORDER BY n * l * l + m * r * r DESC, i LIMIT 1),
    e AS (SELECT avg(abs(demand - CASE CASE best.i {" ".join(
        f"WHEN {i} THEN {x} <= {k}" for i, (x, k) in enumerate(STUMP_SIDES))} END
        WHEN true THEN best.l ELSE best.r END)) AS mae FROM b, best)
    SELECT step AS "stepSize", 1.0::DOUBLE AS "maxDepth", 1.0::DOUBLE AS "maxIter", round(mae, 5) AS mae, 1::BIGINT AS fitted
    FROM e, (SELECT CAST(unnest([{", ".join(str(x) for x in STUMPS["stepSize"])}]) AS DOUBLE) AS step)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        week_offsets, lag_features, rolling_features, same_hour_means, sparse_lags, category_codes,
        calendar_features, baseline_backtest, sparse_baseline, same_hour_backtest, baseline_rows,
        split_rows, four_lag_weights, linear_by_series_rows, forecast_sample, series_weights,
        top_weights, series_weights_intercept, top_weights_intercept, undated_offsets, undated_lags, gbt_forecast, poisson_forecast, model_comparison, gbt_search,
        poisson_errors, three_way_errors, chunked_lags, chunked_sparse_lags, chunked_moving_mean, exponential_means,
        rolling_medians, cut_weights, tree_errors, three_way_trees, year_backtest, tree_inputs, backtest_inputs,
    )
} | {
    "linear_global": _linear(False, False),
    "linear_global_intercept": _linear(False, True),
    "linear_by_series": _linear(True, False),
    "linear_by_series_intercept": _linear(True, True),
}
