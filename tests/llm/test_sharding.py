import pytest
from pyspark.sql import functions as F

from vaaksetu.llm import sharding
from vaaksetu.llm.queries import ORACLE_SQL, QUERIES, SHARDS

from .oracle import same


def test_table():
    t = sharding.lookup_table(SHARDS, 4099)
    sizes = [t.count(i) for i in range(len(SHARDS))]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 4099
    # Without one shard, its slots move and few others do.
    names = [s for i, s in enumerate(SHARDS) if i != 7]
    u = sharding.lookup_table(names, 4099)
    moved = sum(SHARDS[a] != names[b] for a, b in zip(t, u) if a != 7)
    assert moved < 0.05 * 4099
    w = sharding.lookup_table(["a", "b"], 101, [3, 1])
    assert abs(w.count(0) - 76) <= 2
    for bad in ((["a"], 100), (["a", "a"], 101), ([], 101)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_turns_by_hand():
    """A plain replay: at each turn a shard takes the first free slot of its full permutation."""
    import hashlib

    names, m = ["x", "y", "z"], 13
    prefs = []
    for s in names:
        d = hashlib.md5(s.encode()).digest()
        o, k = int.from_bytes(d[:8], "big") % m, int.from_bytes(d[8:], "big") % (m - 1) + 1
        prefs.append([(o + j * k) % m for j in range(m)])
    want = {}
    for turn in range(m):
        want[next(p for p in prefs[turn % 3] if p not in want)] = turn % 3
    assert sharding.lookup_table(names, m) == [want[i] for i in range(m)]


def test_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, None), (2, "")], "doc_id long, shard string")
    out = sharding.assign_shards(df).collect()
    assert len(out) == 4 and len({r.shard for r in out if r.doc_id == 1}) == 1 and all(r.shard for r in out)
    assert sharding.assign_shards(df.where("false")).count() == 0
    sharding.write_shards(df.select("doc_id"), f"{tmp_path}/out", spread=2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_sql(spark):
    assert same(spark, QUERIES["op10_sharding"], ORACLE_SQL["op10_sharding"], "/root/testdata/sf0.01") == 1000


def test_largest_table(spark):
    """As many slots as there may be: built and asked in a few seconds, the same places as the table itself."""
    import time

    names = [f"s{i}é" for i in range(5000)]
    start = time.time()
    rows = spark.range(2000).withColumnRenamed("id", "doc_id").withColumn("_slot", F.lit(1)).withColumn("Shard", F.lit("x"))
    got = sharding.assign_shards(rows, "doc_id", names, sharding.MAX_SLOTS).collect()
    assert time.time() - start < 60
    table = sharding.lookup_table(names, sharding.MAX_SLOTS)
    assert len(got) == 2000 and all(r.shard == names[table[r.shard_slot]] and r._slot == 1 for r in got)
    assert sharding.assign_shards(rows.where("false")).count() == 0
