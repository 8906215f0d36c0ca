"""The queries opN_<name> over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, secrets, sharding
from .common import read

SHARDS = [f"shard-{i:02d}" for i in range(32)]


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(read(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    got = simhash_components(read(spark, sf_dir, "documents"), shingle=3, distance=3)
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op1_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import embedding_components

    got = embedding_components(read(spark, sf_dir, "embeddings"))
    return got.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, count_kind, find_secrets, named

    got = find_secrets(read(spark, sf_dir, "documents"))
    counts = [count_kind("base", k).alias(f"n_{k}") for k in BASE]
    return got.select(F.col("id").alias("doc_id"), *counts, F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(read(spark, sf_dir, "documents"), mixing.driver_levels(), mixing.WEIGHTS, mixing.BUDGET, mixing.MAX_EPOCHS, mixing.SEED)
    return got.withColumnRenamed("id", "doc_id")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_pieces

    got = encode_pieces(read(spark, sf_dir, "documents").select("doc_id", "text"), verify=True)
    return got.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.md5(F.array_join("piece_ids", ",")).alias("pieces_md5"), "decoded", "parity")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


QUERIES = {"op1_embed_dedup": op1_embed_dedup, "op2_secrets": op2_secrets, "op3_mixing": op3_mixing, "op4_suffix_tree": op4_suffix_tree, "op5_passages": op5_passages, "op6_ann": op6_ann, "op7_simhash": op7_simhash, "op8_langid": op8_langid, "op9_pieces": op9_pieces, "op10_sharding": op10_sharding}

ORACLE_SQL: dict[str, str] = {"op2_secrets": secrets.oracle_sql(), "op3_mixing": mixing.oracle_sql(), "op10_sharding": sharding.oracle_sql(SHARDS)}
