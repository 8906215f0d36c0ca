"""Where queries register, each with the DuckDB SQL that must give the same rows, and pieces of SQL that several of them use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import bound_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for files that a query writes and reads back: under spark.checkpoint.dir, or local where executors are threads of the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='vaaksetu-')}"
    return f"{folder.rstrip('/')}/vaaksetu/{name}-{uuid.uuid4().hex}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(texts: Iterable[str]) -> str:
    """A DuckDB list of texts."""
    return "[" + ", ".join(map(quoted, texts)) + "]"


SPLIT = r"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def edit_tables(source: str, name: str, r: str = "r", p: str = "p") -> str:
    """CTE `name`: the rows of source with e_<name>, the edits between the lists of words r and p, by the table of distances.

    The outer fold adds a row of the table for each reference word, the inner one a cell for each predicted word.
    """
    return f"""
  {name}_words AS (SELECT *, list_distinct(list_concat({r}, {p})) AS d FROM {source}),
  {name}_coded AS (SELECT *, list_transform({p}, lambda w: list_position(d, w)::INT) AS h, list_transform({r}, lambda w: [list_position(d, w)::INT]) AS ref,
    list_transform(range(1, len({p}) + 1), lambda j: [j::INT]) AS steps, range(0, len({p}) + 1)::INT[] AS first FROM {name}_words),
  {name} AS (SELECT * EXCLUDE (d, h, ref, steps, first),
    list_reduce(ref, lambda up, x: list_reduce(steps, lambda row, j: list_append(row, least(up[j[1]] + (x[1] <> h[j[1]])::INT, up[j[1] + 1] + 1, row[-1] + 1)), [up[1] + 1]), first)[-1]::BIGINT AS e_{name} FROM {name}_coded)"""
