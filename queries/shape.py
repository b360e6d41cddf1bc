"""Make results comparable with SQL: whole numbers as BIGINT, rounded doubles,
dates as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _replace(df: DataFrame, kind: type | tuple, change) -> DataFrame:
    return df.select(*[
        change(f.name).alias(f.name) if isinstance(f.dataType, kind) else F.col(f.name)
        for f in df.schema
    ])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return _replace(df, T.DoubleType, lambda c: F.round(c, digits) + F.lit(0.0))


def bigints(df: DataFrame) -> DataFrame:
    return _replace(df, (T.IntegerType, T.ShortType), lambda c: F.col(c).cast("bigint"))


def texts(df: DataFrame) -> DataFrame:
    return _replace(df, T.DateType, lambda c: F.col(c).cast("string"))


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    return texts(bigints(rounded(df, digits)))
