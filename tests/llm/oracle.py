"""Compares a query with its DuckDB SQL over one folder of tables, as unordered rows."""

import glob
import os

import duckdb


def tables(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        src = f if os.path.isfile(f) else f"{f}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    return v


def same(spark, query, sql, folder):
    got = query(spark, folder)
    cols = sorted(got.columns)
    rel = tables(folder).sql(sql)
    assert sorted(rel.columns) == cols
    mine = sorted((tuple(norm(r.asDict(True)[c]) for c in cols) for r in got.collect()), key=repr)
    ref = sorted((tuple(norm(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert len(mine) == len(ref)
    assert mine == ref, next((a, b) for a, b in zip(mine, ref) if a != b)
    return len(mine)
