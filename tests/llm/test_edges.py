"""Pipeline stages and operators on empty tables, nulls, repeated rows and clashing columns."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from vaaksetu.llm import common, jaccard, langid, mixing, secrets, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = {"_lid": "x", "_keep": 1, "_KEY": "k", "_spans": "s", "_found": "f", "_used": 2, "n": 3, "rest": 4, "cap": 5, "full": 6, "id": 7, "key": "y", "component": 8, "_slot": 9, "h": 1, "pos": 2, "rows": 3, "budget": 4}


def odd(spark):
    words = " ".join(f"wort{i} und" for i in range(60))
    rows = [(1, words, "de", "src1", 1), (1, words, "de", "src1", 1), (2, words, "de", "src1", 1), (None, words, "de", "src2", 1), (None, words, "de", "src2", 1), (3, None, None, None, None), (4, "", "en", "src0", 0),
            (5, "the secret login=bob pwd: abcd12 and password = hunter2x", None, None, 50), (6, "some plain words of english here", "en", "src0", 30), (7, "12 34", "en", "src0", 5)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(v) for c, v in EXTRA.items()})


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stage_of_an_empty_table(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    got = dict(cp.STAGES)[name](spark, docs, "")
    assert got.count() == 0 and (name == "tokens" or got.columns == docs.columns)


def test_stages_keep_columns_whatever_their_names(spark):
    docs = odd(spark)
    for name, step in cp.STAGES[:-1]:
        columns = docs.columns
        docs = step(spark, docs, "")
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows and all(r[c] == v for r in rows for c, v in EXTRA.items()), name
        docs = spark.createDataFrame(rows, docs.schema)
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 0, 1, 5, 6]
    assert dict(cp.STAGES)["tokens"](spark, docs, "").count() == 5


def test_language_stage(spark):
    got = langid.keep_known(odd(spark)).collect()
    # Null and empty texts and texts without a letter go; repeated rows and null ids stay.
    assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 1, 2, 5, 6]
    assert all(r.lang in ("de", "en") for r in got)


def test_redact(spark):
    docs = odd(spark).unionByName(odd(spark).where("doc_id = 5"))
    got = secrets.redact(docs).collect()
    assert len(got) == 11
    masked = [r for r in got if r.doc_id == 5]
    assert len(masked) == 2 and all("hunter2x" not in r.text and "bob" not in r.text and r.n_chars == len(r.text) for r in masked)
    assert sum(r.text is None for r in got) == 1 and sum(r.doc_id is None for r in got) == 2
    assert secrets.redact(docs.where("false")).count() == 0


def test_dedup_keeps_null_ids(spark):
    for dedup in (simhash.simhash_dedup, jaccard.jaccard_dedup):
        got = dedup(odd(spark)).collect()
        ids = [r.doc_id for r in got]
        assert ids.count(None) == 2 and ids.count(1) == 1 and 2 not in ids and 5 in ids and 6 in ids
        assert 3 in ids and 4 not in ids  # null and empty texts are copies


def test_levels_of_any_name(spark):
    docs = odd(spark)
    got = mixing.mix(docs, {"rest": F.col("lang"), "n": F.col("source")}, {}, (1, 2), 1)
    assert got.columns[:3] == ["id", "rest", "n"] and got.count() == docs.count()
    with pytest.raises(ValueError):
        mixing.mix(docs, {"id": F.col("lang")}, {})


def test_write_shards(spark, tmp_path):
    docs = odd(spark)
    sharding.write_shards(docs, f"{tmp_path}/s", shards=["a", "b"], slots=101)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == docs.count() and back.where("doc_id is null").select("shard").distinct().count() == 1


def test_staged_tables(spark):
    staged = common.stage(spark.range(5), "some")
    assert staged.count() == 5
    common.unstage(staged)
    with pytest.raises(Exception):  # noqa: B017  whatever Spark calls files that are gone
        staged.collect()
    assert common.fresh("_A", spark.range(1).withColumnRenamed("id", "_a")) == "_A_"
