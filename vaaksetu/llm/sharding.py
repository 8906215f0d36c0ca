"""Placement of rows on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
import struct
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: The largest lookup table, and the longest name of a shard in bytes; what is broadcast is bounded by them whatever the input.
MAX_SLOTS, MAX_NAME = 655_373, 128


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = 4099, weights: list[int] | None = None) -> list[int]:
    """Slot -> index of the shard that owns it.

    Each shard has a permutation of the slots, (offset + j * skip) mod slots, from the digest of its
    name; as slots is prime any skip from 1 to slots - 1 visits all of them. Shards take turns, each
    claiming the first slot of its permutation that is still free (a shard of weight w claims w a turn).
    Each shard so gets its share to within a turn, and a removed shard's slots are spread over the
    others while nearly all other slots stay where they were.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _is_prime(slots) or slots > MAX_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or max(weights) < 1:
        raise ValueError("weights must be one count for each shard, not all zero")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    table, left = [-1] * slots, slots
    while True:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = i
                left -= 1
                if not left:
                    return table


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 60 bits of the MD5 digest of its text, modulo the table's size. A null key counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % F.lit(slots)


def owners(spark: SparkSession, shards: list[str], table: list[int]) -> DataFrame:
    """(slot, shard) of a lookup table, built in Spark from one packed literal: 8 bytes a slot say where the owner's name lies among all names."""
    names = [s.encode() for s in shards]
    if max(map(len, names)) > MAX_NAME:
        raise ValueError(f"a shard's name has more than {MAX_NAME} bytes")
    starts = list(accumulate(map(len, names), initial=0))
    entry = [struct.pack(">II", starts[i] + 1, len(n)) for i, n in enumerate(names)]
    packed, blob = F.lit(b"".join(entry[i] for i in table)), F.lit(b"".join(names))
    number = lambda at: F.conv(F.hex(F.substring(packed, at.cast("int"), F.lit(4))), 16, 10).cast("int")
    rows = spark.range(len(table)).select(F.col("id").alias("slot"), number(F.col("id") * 8 + 1).alias("at"), number(F.col("id") * 8 + 5).alias("size"))
    return rows.select("slot", F.decode(F.substring(blob, F.col("at"), F.col("size")), "UTF-8").alias("shard"))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = 4099, weights: list[int] | None = None) -> DataFrame:
    """df with the columns shard_slot (long) and shard (string): where each row goes, in constant time a row.

    The table of at most MAX_SLOTS entries, each with a name of at most MAX_NAME bytes, is broadcast and a row looks its slot up
    in it: no shuffle, and no task that a hot key could overload. Equal keys go to the same shard; null keys go where the
    empty text goes; repeated rows stay; an empty table gives an empty one. Columns of df that have these names are replaced.
    """
    shards = shards or [f"shard-{i:02d}" for i in range(32)]
    at = fresh("_slot", df)
    table = owners(df.sparkSession, shards, lookup_table(shards, slots, weights)).select(F.col("slot").alias(fresh("_owned", df)), F.col("shard").alias(fresh("_owner", df)))
    placed = df.withColumn(at, slot_of(df[key], slots)).join(F.broadcast(table), F.col(at) == F.col(table.columns[0]), "left")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard_slot", "shard")]
    return placed.select(*kept, F.col(at).alias("shard_slot"), F.col(table.columns[1]).alias("shard"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", spread: int = 16, **options) -> None:
    """Writes one folder of Parquet files for each shard.

    Rows of a shard are spread over `spread` tasks by their whole content's hash, so a shard that holds
    many rows, or copies of one key, isn't written by a single task. Null keys go where the empty text goes, repeated rows stay,
    an empty table writes no folder.
    """
    placed = assign_shards(df, key, **options)
    salt = F.pmod(F.xxhash64(*[placed[c] for c in df.columns]), F.lit(spread))
    placed.repartition(F.col("shard"), salt).write.partitionBy("shard").mode("errorifexists").parquet(path)


def oracle_sql(shards: list[str], slots: int = 4099) -> str:
    """DuckDB SQL for assign_shards over documents; the table is filled here, in the way the docstring of lookup_table says."""
    table = ", ".join(map(str, lookup_table(shards, slots)))
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
    WITH placed AS (
      SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots} AS shard_slot FROM documents
    )
    SELECT doc_id, shard_slot, ([{names}])[([{table}])[shard_slot + 1] + 1] AS shard FROM placed"""
