"""Spark rows against DuckDB rows, whatever their order."""

import os

import duckdb


def connect(d):
    con = duckdb.connect()
    for f in os.listdir(d):
        p = f"{d}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (bool, int, str)) else str(v)


def same(df, con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=key)
    assert len(mine) == len(theirs)
    assert mine == theirs
