"""Exponentially weighted means and rolling medians of a series.

Both end one row before the one-week lag, like the rolling means of ``features``.
Functions of this module travel to the workers with their jobs, so executors need
not have it installed.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotcast.functions.checkpoints import checkpointed
from slotcast.functions.rows import quoted
from slotcast.grid import HOURLY, SLOT, Grid
from slotcast.operators.chunks import PLACE, over_chunks, placed
from slotcast.operators.joins import dealt_join

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Spans of the published means, in rows.
SPANS = {"ewm_6h": 6, "ewm_24h": 24, "ewm_7d": 168}
MEDIANS = {"roll_median_24h": 24, "roll_median_7d": 168}
CHUNK_ROWS = 8192


def _steps(place: np.ndarray, value: np.ndarray, before: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the pair (factor, sum) that turns the mean before the chunk
    into the mean at that row. ``before`` is the place of the last value earlier on."""
    factors, sums = np.empty(len(place)), np.empty(len(place))
    factor, total, last = 1.0, 0.0, before
    for i, (at, x) in enumerate(zip(place.tolist(), value.tolist())):
        if x == x:  # a missing value leaves the mean and lets it weigh less
            if last != last:
                factor, total = 0.0, x
            else:
                old = (1 - alpha) ** (at - last)
                factor, total = factor * old / (old + alpha), (total * old + alpha * x) / (old + alpha)
            last = at
        factors[i], sums[i] = factor, total
    return factors, sums


def exponential_means(
    df: DataFrame, spans: Mapping[str, int] = SPANS, grid: Grid = HOURLY, size: int = CHUNK_ROWS, shift: int | None = None
) -> DataFrame:
    """``df`` with the exponentially weighted mean of each span, ``shift`` rows
    back (by default one more than a week).

    The mean m follows m' = (1 - a) m + a x with a = 2 / (span + 1), from the first
    value on; a missing value keeps the mean, whose weight goes on falling. Each
    step is a pair (factor, sum), and pairs of successive rows make one again. So a
    series is cut into chunks of ``size`` rows, whose pairs are worked out apart;
    the pairs of whole chunks, one row each, give the mean each chunk starts with.
    """
    shift = grid.week + 1 if shift is None else shift
    names, keys = list(spans), list(grid.keys)
    complete = F.expr(" AND ".join(f"{quoted(k)} IS NOT NULL" for k in keys) or "true")
    chunk = F.floor(F.col(PLACE) / size).cast("long")
    rows = placed(df, grid).withColumn("_x", F.when(complete, F.col(grid.value).cast("double"))).withColumn("_part", chunk)
    known = F.when(F.col("_x").isNotNull(), F.col(PLACE))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*keys, "_part").agg(F.max(known).alias("_known")).select(
        *keys, "_part", F.max("_known").over(ahead).alias("_before")
    )
    given = dealt_join(rows, last, [*keys, "_part"])
    alphas = [2.0 / (spans[n] + 1) for n in names]

    def steps(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        place, value = part["_place"].to_numpy(), part["_x"].to_numpy(dtype=float)
        before = float(part["_before"].iloc[0]) if pd.notna(part["_before"].iloc[0]) else float("nan")
        made = [_steps(place, value, before, a) for a in alphas]
        out = part.drop(columns=["_x", "_before"])
        out["_f"] = list(np.stack([f for f, _ in made], axis=1))
        out["_s"] = list(np.stack([s for _, s in made], axis=1))
        return out

    pair = [T.StructField("_f", T.ArrayType(T.DoubleType())), T.StructField("_s", T.ArrayType(T.DoubleType()))]
    index = [f for f in given.schema if f.name in (*keys, "_part", PLACE)]
    slim = given.select(*[f.name for f in index], "_x", "_before")
    stepped = checkpointed(slim.groupBy(*keys, "_part").applyInPandas(steps, T.StructType([*index, *pair])))

    def starts(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("_part")
        mean, found = np.zeros(len(names)), []
        for f, s in zip(parts["_f"], parts["_s"]):
            found.append(mean)
            mean = np.asarray(f) * mean + np.asarray(s)
        out = parts.drop(columns=["_f", "_s"])
        out["_m"] = found
        return out

    ends = stepped.groupBy(*keys, "_part").agg(
        F.max_by("_f", PLACE).alias("_f"), F.max_by("_s", PLACE).alias("_s")
    )
    start_schema = T.StructType([*[f for f in index if f.name != PLACE], T.StructField("_m", T.ArrayType(T.DoubleType()))])
    began = ends.groupBy(*keys).applyInPandas(starts, start_schema)
    first = rows.groupBy(*keys).agg(F.min(known).alias("_first"))
    meant = dealt_join(dealt_join(stepped, began, [*keys, "_part"]), first, keys)
    means = {
        f"_{n}": F.when(F.col(PLACE) >= F.col("_first"), F.col("_f")[i] * F.col("_m")[i] + F.col("_s")[i])
        for i, n in enumerate(names)
    }
    meant = meant.select(*keys, PLACE, *[c.alias(n) for n, c in means.items()])

    def shifted(window: WindowSpec) -> dict[str, Column]:
        return {n: F.lag(f"_{n}", shift).over(window) if shift else F.col(f"_{n}") for n in names}

    moved = over_chunks(meant, shifted, shift, max(size, 8 * shift), grid).drop(*means)
    return dealt_join(rows.drop("_x", "_part"), moved, [*keys, PLACE]).drop(PLACE, SLOT)


class _Sliding:
    """The values of a frame of ``width`` rows in order: one is put in its place
    and one taken out per row, so no frame is ever sorted."""

    def __init__(self, width: int):
        self.width, self.ordered = width, []

    def step(self, entering: float | None, leaving: float | None) -> float | None:
        if leaving is not None:
            del self.ordered[bisect_left(self.ordered, leaving)]
        if entering is not None:
            insort(self.ordered, entering)
        if len(self.ordered) < self.width:
            return None
        half = self.width // 2
        return self.ordered[half] if self.width % 2 else (self.ordered[half - 1] + self.ordered[half]) / 2


def rolling_medians(
    df: DataFrame, widths: Mapping[str, int] = MEDIANS, grid: Grid = HOURLY, skip: int | None = None
) -> DataFrame:
    """``df`` with the median of each number of rows that end ``skip`` + 1 rows
    back (by default a week and one); null unless all of them are there.

    One shuffle and one sort bring each series together in order; a task reads its
    rows as they come and keeps the last ``skip`` + width values, whatever the
    length of a series.
    """
    skip = grid.week if skip is None else skip
    keys = list(grid.keys)
    complete = F.expr(" AND ".join(f"{quoted(k)} IS NOT NULL" for k in keys) or "true")
    value = F.col(grid.value).cast("double")
    ordered = (
        df.withColumns({SLOT: grid.slot(), "_x": F.when(complete & ~F.isnan(value), value)})
        .repartition(*(keys or [1])).sortWithinPartitions(*keys, F.col(SLOT).asc_nulls_last())
    )
    longest, named, given = skip + 1 + max(widths.values()), dict(widths), df.columns
    schema = T.StructType([*df.schema, *[T.StructField(n, T.DoubleType()) for n in named]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, past, frames = None, deque(), {}
        for batch in batches:
            made: dict[str, list[float | None]] = {n: [] for n in named}
            owners = zip(*(batch.column(k).to_pylist() for k in keys)) if keys else ((),) * batch.num_rows
            for owner, x in zip(owners, batch.column("_x").to_pylist()):
                if owner != series:
                    series, past = owner, deque(maxlen=longest)
                    frames = {n: _Sliding(width) for n, width in named.items()}
                entering = past[-skip - 1] if len(past) > skip else None
                for n, width in named.items():
                    leaving = past[-skip - 1 - width] if len(past) > skip + width else None
                    made[n].append(frames[n].step(entering, leaving))
                past.append(x)
            columns = [batch.column(c) for c in given] + [pa.array(made[n], pa.float64()) for n in named]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ordered.mapInArrow(run, schema)
