"""Parsing, parts, names and intervals of dates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and their order as the published profiles show them.
MONTHS = (
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
BUSINESS_DAY, WEEKEND = "Dia útil", "Fim de semana"


def parse_day(text: Column | str, fmt: str = "d/M/yyyy") -> Column:
    """Text to date, with one or two digits for day and month; text that is no
    date becomes null."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def parse_hour(text: Column | str, fmt: str = "H:m") -> Column:
    return F.hour(F.try_to_timestamp(text, F.lit(fmt)))


def name_at(names: Iterable[str], position: Column) -> Column:
    """Name for a position counted from 0; null outside the list."""
    return F.get(F.array(*[F.lit(n) for n in names]), position)


def month_name(date: Column | str) -> Column:
    return name_at(MONTHS, F.month(date) - 1)


def weekday_name(date: Column | str) -> Column:
    return name_at(WEEKDAYS, F.weekday(date))


def day_type(date: Column | str) -> Column:
    return F.when(
        weekday_name(date).isin("Saturday", "Sunday"), F.lit(WEEKEND)
    ).otherwise(F.lit(BUSINESS_DAY))


def within(date: Column | str, windows: Iterable[tuple[str, str]]) -> Column:
    """Is the date in any of the closed intervals; a null date is in none."""
    date = F.col(date) if isinstance(date, str) else date
    inside = F.lit(False)
    for start, end in windows:
        inside = inside | date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return F.coalesce(inside, F.lit(False))


def since_until(date: str, start: str | None, end: str | None) -> Column:
    """The half-open interval from ``start`` up to, not including, ``end``."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        keep = keep & (F.col(date) < F.lit(end).cast("date"))
    return keep


def calendar_features(date: str = "date") -> dict[str, Column]:
    weekday = F.weekday(date)
    angle = F.lit(2.0) * F.pi() * weekday / F.lit(7.0)
    return {
        "weekday": weekday,
        "month": F.month(date),
        "day": F.day(date),
        "weekofyear": F.weekofyear(date),
        "dayofyear": F.dayofyear(date),
        "quarter": F.quarter(date),
        "weekday_sin": F.sin(angle),
        "weekday_cos": F.cos(angle),
    }
