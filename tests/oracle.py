"""Compares a query with its SQL on the same tables."""

import decimal
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def same(df, sql, folder=DATA):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    r = con.sql(sql)
    cols = list(r.columns)
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(cols, r.fetchall())
