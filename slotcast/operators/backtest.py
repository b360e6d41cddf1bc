"""Time-ordered splits, baselines and error tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.functions.dates import since_until
from slotcast.functions.rows import row_mean
from slotcast.grid import HOURLY, Grid
from slotcast.operators.features import HORIZONS, ahead, past

Span = tuple[str | None, str | None]


def predicted(h: int, method: str) -> str:
    return f"p_{ahead(h)}_{method}"


def in_span(df: DataFrame, span: Span, date: str = "date") -> DataFrame:
    """Rows from the first date up to, not including, the second."""
    return df.filter(since_until(date, *span))


def split(
    df: DataFrame, *spans: Span, date: str = "date", embargo_days: int = 0
) -> tuple[DataFrame, ...]:
    """One table per half-open span. With an embargo each span but the last
    ends that many days earlier, so that targets up to so many days ahead do
    not reach into the next span."""
    parts = []
    for i, (start, end) in enumerate(spans):
        part = in_span(df, (start, end), date)
        if embargo_days and end is not None and i < len(spans) - 1:
            part = part.filter(
                F.col(date) < F.date_sub(F.lit(end).cast("date"), embargo_days)
            )
        parts.append(part)
    return tuple(parts)


def around(df: DataFrame, span: Span, date: str = "date", back: int = 28, forward: int = 35):
    """The rows that offsets of a span can reach. This filter is on a plain
    column before the window, so on a table it prunes the scan, which a filter
    on the span after the window cannot do. It does not pass a filled grid."""
    start, end = span
    if start is not None:
        df = df.filter(F.col(date) >= F.date_sub(F.lit(start).cast("date"), back))
    if end is not None:
        df = df.filter(F.col(date) < F.date_add(F.lit(end).cast("date"), forward))
    return df


def with_recursive_mean(df: DataFrame, grid: Grid = HOURLY, method: str = "baseline") -> DataFrame:
    """Forecast 1 to 5 weeks ahead as means of the current value, the last two
    weeks and the forecasts already made."""
    inputs = {
        1: [grid.value, past(1), past(2)],
        2: [grid.value, past(1), predicted(1, method)],
        **{h: [grid.value, *[predicted(i, method) for i in range(1, h)]] for h in (3, 4, 5)},
    }
    for h in HORIZONS:
        df = df.withColumn(predicted(h, method), row_mean(*inputs[h]))
    return df


def with_same_hour_mean(df: DataFrame, method: str = "baseline") -> DataFrame:
    """The mean of the last three weeks at the same hour, for every horizon."""
    return df.withColumns(
        {predicted(h, method): F.col("same_hour_mean_3w") for h in HORIZONS}
    )


def errors(truth: Column, guess: Column) -> dict[str, Column]:
    """Aggregates over the rows that have both figures."""
    gap = truth - guess
    return {"mae": F.avg(F.abs(gap)), "mse": F.avg(gap * gap), "rmse": F.sqrt(F.avg(gap * gap))}


def score(
    df: DataFrame, methods: Sequence[str], horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """(horizon, method, mae, mse, rmse), over rows on which the truth and all
    methods are known. All figures are aggregates of one pass; only their one
    row is turned into the long table."""
    cells, names = [], []
    for h in horizons:
        columns = [F.col(ahead(h)), *[F.col(predicted(h, m)) for m in methods]]
        known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
        truth = F.when(known, columns[0])
        for method, guess in zip(methods, columns[1:]):
            figures = errors(truth, guess)
            name = f"{h}_{method}"
            cells.append(F.struct(*[c.alias(k) for k, c in figures.items()]).alias(name))
            names.append((name, h, method))
    one = df.agg(*cells)
    rows = F.array(*[
        F.struct(
            F.lit(h).alias("horizon"), F.lit(m).alias("method"),
            *[F.col(n).getField(k).alias(k) for k in ("mae", "mse", "rmse")],
        )
        for n, h, m in names
    ])
    return one.select(F.inline(rows))


def compare(scores: DataFrame, baseline: str, models: Sequence[str]) -> DataFrame:
    """One row per horizon: the errors of each method and, for each model, how
    far they lie from the baseline's."""
    figures = ("mae", "mse", "rmse")
    wide = scores.groupBy("horizon").agg(*[
        F.max(F.when(F.col("method") == m, F.col(k))).alias(f"{k}_{m}")
        for m in (baseline, *models)
        for k in figures
    ])
    gaps: Mapping[str, Column] = {
        f"diff_{k}_{m}": F.col(f"{k}_{m}") - F.col(f"{k}_{baseline}")
        for m in models
        for k in figures
    }
    return wide.withColumns(gaps)
