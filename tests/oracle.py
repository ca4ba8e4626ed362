"""Runs a query and its SQL on the same tables and compares the rows."""

import math
import os


def connect(d):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(d):
        p = f"{d}/{t}"
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _norm(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if v is None or isinstance(v, int) else str(v)


def same(spark, c, d, query, sql):
    df = query(spark, d)
    cols = sorted(df.columns)
    mine = sorted((tuple(_norm(r[k]) for k in cols) for r in df.collect()), key=str)
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(k) for k in cols]
    theirs = sorted((tuple(_norm(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert len(mine) == len(theirs)
    assert mine == theirs
