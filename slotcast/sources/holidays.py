"""National holidays of Brazil as a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month, day, name, first year as a national holiday.
FIXED_DATES = (
    (1, 1, "Confraternização Universal", 1890),
    (4, 21, "Tiradentes", 1933),
    (5, 1, "Dia do Trabalhador", 1925),
    (9, 7, "Independência do Brasil", 1890),
    (10, 12, "Nossa Senhora Aparecida", 1980),
    (11, 2, "Finados", 1890),
    (11, 15, "Proclamação da República", 1890),
    (11, 20, "Dia Nacional de Zumbi e da Consciência Negra", 2024),
    (12, 25, "Natal", 1922),
)
# Days from Easter Sunday, name.
EASTER_DATES = ((-2, "Sexta-feira Santa"),)

def year_range(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def years_of(df: DataFrame, date: str = "date") -> DataFrame:
    """Every year from the first to the last date of a table."""
    bounds = df.agg(F.year(F.min(date)).alias("first"), F.year(F.max(date)).alias("last"))
    return bounds.filter("first is not null").select(
        F.explode(F.sequence("first", "last")).alias("year")
    )


def with_easter(years: DataFrame) -> DataFrame:
    return years.select("year", easter(F.col("year")).alias("easter"))


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("int")


def easter(year: Column) -> Column:
    """Easter Sunday by the Gregorian computus, as integer column arithmetic."""
    golden, century = year % 19, _div(year, 100)
    skipped = century - _div(century, 4) - _div(century - _div(century + 8, 25) + 1, 3)
    epact = (19 * golden + skipped + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * _div(year % 100, 4) - epact - year % 4) % 7
    late = _div(golden + 11 * epact + 22 * weekday, 451)
    ahead = epact + weekday - 7 * late + 114
    return F.make_date(year.cast("int"), _div(ahead, 31), (ahead % 31 + 1).cast("int"))


def holiday_name(date: Column) -> Column:
    """The holiday of a date, from the date's own year, so that no calendar and
    no span of years is needed; null on other days. Names that fall on one date
    are joined in alphabetical order."""
    year, month, day = F.year(date), F.month(date), F.day(date)
    named = [
        F.when((month == m) & (day == d) & (year >= since), F.lit(name))
        for m, d, name, since in FIXED_DATES
    ]
    named += [
        F.when(date == F.date_add(easter(year), days), F.lit(name)) for days, name in EASTER_DATES
    ]
    names = F.sort_array(F.array_compact(F.array(*named)))
    return F.when(F.size(names) > 0, F.array_join(names, "; "))


def holiday_calendar(years: DataFrame) -> DataFrame:
    """(date, holiday_name): one row per date, at most about ten a year. Names
    that fall on one date are joined in alphabetical order."""
    fixed = F.inline(
        F.array(*[
            F.struct(
                F.lit(month).alias("m"), F.lit(day).alias("d"),
                F.lit(name).alias("holiday_name"), F.lit(since).alias("since"),
            )
            for month, day, name, since in FIXED_DATES
        ])
    )
    moving = F.inline(
        F.array(*[
            F.struct(F.lit(days).alias("days"), F.lit(name).alias("holiday_name"))
            for days, name in EASTER_DATES
        ])
    )
    by_date = years.select("year", fixed).filter("year >= since").selectExpr(
        "make_date(year, m, d) AS date", "holiday_name"
    )
    by_easter = with_easter(years).select("easter", moving).selectExpr(
        "date_add(easter, days) AS date", "holiday_name"
    )
    names = F.array_sort(F.collect_set("holiday_name"))
    return (
        by_date.unionByName(by_easter)
        .groupBy("date")
        .agg(F.concat_ws("; ", names).alias("holiday_name"))
    )
