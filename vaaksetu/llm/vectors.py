"""Vectors in tables: which take part, and how they travel between tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<float or double>) of the rows that take part: id not null, vector not null, empty or zero, all components finite."""
    inf = float("inf")
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(vec_col, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))


def matrix(column) -> np.ndarray:
    """Rows of equal length as doubles."""
    return np.array([np.asarray(v, np.float64) for v in column], np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaling by the largest component first keeps squares of very small or large ones in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
