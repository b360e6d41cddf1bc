"""Small panels for tests."""

import datetime as dt


def day(text):
    return dt.date.fromisoformat(text)


def panel(spark, rows, columns="service_id long, sector string, date date, hour int, demand double"):
    fixed = [tuple(day(v) if isinstance(v, str) and len(v) == 10 and v[4] == "-" else v for v in r)
             for r in rows]
    return spark.createDataFrame(fixed, columns)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
