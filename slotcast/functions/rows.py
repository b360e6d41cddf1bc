"""Arithmetic across the columns of one row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def row_mean(*columns: Column | str) -> Column:
    """Mean of the values present; null only where all of them are null."""
    cols = [_col(c) for c in columns]
    present = _sum([c.isNotNull().cast("double") for c in cols])
    return F.try_divide(_sum([F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols]), present)


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """Weighted sum of columns; null as soon as one of them is null."""
    return _sum([F.lit(float(w)) * F.col(c) for c, w in weights.items()])


def not_negative(c: Column | str) -> Column:
    """Raise negative values to 0 and keep nulls (``greatest`` would lose them)."""
    c = _col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def label(*columns: str, sep: str = " - ") -> Column:
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def dot(a: str, b: str) -> Column:
    """Product of two arrays of doubles, each given as SQL. As one expression
    over arrays it stays small; written out, nineteen terms for each of five
    horizons make generated code too large to be compiled, and slower."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, v) -> s + v)")
