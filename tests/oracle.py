"""Compare a query with its SQL on the same Parquet files."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(cells, key=repr)


def compare(spark, sf, query, sql):
    """Differences as text, or None."""
    df = query(spark, sf)
    cursor = connect(sf).execute(sql)
    names = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    got, want = _rows(df.collect(), df.columns), _rows(expected, names)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    kinds = {
        (type(a), type(b))
        for g, w in zip(got, want)
        for a, b in zip(g, w)
        if a is not None and b is not None and type(a) is not type(b)
    }
    if kinds:
        return f"types {kinds}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} of {len(got)} rows, such as {wrong[0]}" if wrong else None
