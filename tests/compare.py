"""A query's rows against what DuckDB gives for its statement: columns by name, rows in any order, numbers to nine digits."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return f"{v:.9g}" if v != int(v) else str(int(v))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [columns[i] for i in order]


def difference(spark, con, sf, query, sql):
    """None if they agree, else what differs."""
    got = query(spark, sf)
    ours, names = rows(got.columns, [tuple(r) for r in got.collect()])
    cursor = con.execute(sql)
    theirs, other = rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != other:
        return f"columns {names} and {other}"
    if ours != theirs:
        extra, missing = [r for r in ours if r not in theirs][:3], [r for r in theirs if r not in ours][:3]
        return f"{len(ours)} rows and {len(theirs)}; only ours {extra}; only theirs {missing}"
    return None
