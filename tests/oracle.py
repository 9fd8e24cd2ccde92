"""Comparison of a registered query with its SQL, as rows sorted under sorted column names."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)  # both are rounded to six places
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b


def difference(df, con, sql):
    """None if both give the same rows; else what differs first."""
    got = df.collect()
    mine, own = rows_of(df.columns, got)
    cur = con.execute(sql)
    theirs, expected = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine != theirs:
        return f"columns {mine} and {theirs}"
    if len(own) != len(expected):
        return f"{len(own)} and {len(expected)} rows"
    return next((f"{a} and {b}" for a, b in zip(own, expected, strict=True) if not all(map(close, a, b))), None)
