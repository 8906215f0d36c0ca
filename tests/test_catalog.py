import glob
import os

import duckdb
import pytest

from vaaksetu.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    rows = got.collect()
    assert rows
    if name not in ORACLE_SQL:
        return
    rel = db.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert sorted(rel.columns) == cols
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr)
    ref = sorted((tuple(norm(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert len(mine) == len(ref)
    assert mine == ref, next((a, b) for a, b in zip(mine, ref) if a != b)
