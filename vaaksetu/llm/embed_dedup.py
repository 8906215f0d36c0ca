"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .graph import connected_components
from .vectors import matrix, unit, valid

#: Distinct vectors that a cell has on average, and the most cells; beyond them cells grow and are compared in more blocks.
CELL_ROWS, MAX_CELLS = 256, 4096
#: Vectors on which centroids are fitted: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Standard deviations of a near-duplicate's random displacement that a cell reaches over its border, and never less than what makes cells exact.
REACH = 4.0
#: Rows of a block on either side of a product.
HOME_BLOCK, MEMBER_BLOCK = 4096, 8192
#: Numbers of a product of vectors and centroids, and rows of cell members, that a task holds at a time, however many vectors a batch and cells there are.
PRODUCT, ROWS = 1 << 20, 4096


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit rows; a cell that empties starts anew at the row that fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    step = max(1, PRODUCT // k)
    at, fit = np.zeros(len(x), np.int64), np.zeros(len(x))
    for _ in range(rounds):
        for i in range(0, len(x), step):
            dots = x[i : i + step] @ c.T
            at[i : i + step] = dots.argmax(axis=1)
            fit[i : i + step] = dots.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(size < 1e-9)
        c = sums / np.maximum(size, 1e-9)[:, None]
        c[empty] = x[np.argsort(fit)[: len(empty)]]
    return c


def _fit(rows: DataFrame, n: int, dim: int, threshold: float) -> tuple[np.ndarray, float]:
    """Centroids, and the share of the distance to a border over which a vector is also shown to the cell beyond it."""
    k = int(min(MAX_CELLS, SAMPLE // 4, max(1, -(-n // CELL_ROWS))))
    sample = rows.where(F.size("vec") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toPandas()
    x = unit(matrix(sample["vec"]))
    # Displacements spread over as many dimensions as the data really use.
    spread = np.linalg.eigvalsh(np.cov(x, rowvar=False)) if len(x) > 2 and dim > 1 else np.ones(1)
    used = max(1.0, float(spread.sum() ** 2 / max((spread**2).sum(), 1e-12)))
    # Two vectors on either side of a border are together at most |u - v| from it, so at 1 / sqrt(2 + 2 * threshold) one of them is always shown to the other's cell.
    return spherical_kmeans(x, min(k, len(x))), min(1.0, max(REACH / used**0.5, 1 / (1 + threshold)))


def _members(ids: np.ndarray, mult: np.ndarray, vectors: pd.Series, dim: int, centroids: np.ndarray | None, width: float) -> Iterator[pd.DataFrame]:
    """Vectors of one length as rows of the cells that they are members of, in tables of ROWS rows at most; without centroids all are in cell 0.

    A vector is a member of the cells whose border is nearer than `width`, times the distance of the two centroids.
    """
    step = max(1, PRODUCT // (1 if centroids is None else len(centroids)))
    for i in range(0, len(ids), step):
        x = unit(matrix(vectors.iloc[i : i + step]))
        if centroids is None:
            home, member = np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
        else:
            dots = x @ centroids.T
            home = dots.argmax(axis=1)
            far = width * np.sqrt(np.maximum(0, 2 - 2 * centroids[home] @ centroids.T))
            member = dots.max(axis=1)[:, None] - dots <= far
            member[np.arange(len(x)), home] = True
        bits, data = np.packbits(member, axis=1, bitorder="little"), [r.tobytes() for r in x]
        rows, cells = np.nonzero(member)
        for j in range(0, len(rows), ROWS):
            at, cell = rows[j : j + ROWS], cells[j : j + ROWS]
            own = cell == home[at]
            yield pd.DataFrame({
                "dim": dim, "cell": cell, "id": ids[i + at], "home": home[at], "own": own, "mult": mult[i + at],
                "x": [data[n] for n in at], "bits": [bits[n].tobytes() if o else b"" for n, o in zip(at, own)],
            })


def _links(own: np.ndarray, own_ids: np.ndarray, bits: np.ndarray, all_: np.ndarray, all_ids: np.ndarray, all_home: np.ndarray, cell: int, own_mult: np.ndarray, all_mult: np.ndarray, threshold: float) -> pd.DataFrame:
    """Links between vectors at home in a cell and all its members, as (id, n, root): n links counted here, root the smallest id reached here.

    A pair with both homes here shows twice, once from each side, and each side counts its own. A pair with one home elsewhere
    is counted where the smaller-numbered home is, if the other vector is a member there, else where the larger one is.
    """
    link = np.zeros((len(own), len(all_)), bool)
    n_own, n_all = np.zeros(len(own), np.int64), np.zeros(len(all_), np.int64)
    word, bit = all_home >> 3, (all_home & 7).astype(np.uint8)
    inside = all_home == cell
    for i in range(0, len(own), 512):
        j = slice(i, i + 512)
        near = own[j] @ all_.T >= threshold
        near &= own_ids[j, None] != all_ids[None, :]
        if not near.any():
            continue
        there = (bits[j][:, np.maximum(word, 0)] >> bit) & 1 == 1
        counted = near & (inside | (all_home > cell) | ~there)
        n_own[j] += counted @ all_mult
        n_all += own_mult[j] @ (counted & ~inside)
        link[j] = near
    rows, cols = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
    link = link[np.ix_(rows, cols)]
    a, b = own_ids[rows].copy(), all_ids[cols].copy()
    top = np.iinfo(np.int64).max
    while len(rows):
        low = np.concatenate([np.where(link[i : i + 512], b, top).min(axis=1) for i in range(0, len(rows), 512)])
        a2 = np.minimum(a, low)
        b2 = b.copy()
        for i in range(0, len(rows), 512):
            np.minimum(b2, np.where(link[i : i + 512], a2[i : i + 512, None], top).min(axis=0), out=b2)
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    return pd.DataFrame({"id": np.concatenate([own_ids[rows], all_ids[cols]]), "n": np.concatenate([n_own[rows], n_all[cols]]), "root": np.concatenate([a, b])})


def embedding_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component, kept) for each row of df.

    Vectors with equal components are one row with a count from the start, so any number of copies costs one row.
    Distinct vectors get a home cell, the nearest centroid, and are members of each cell whose border is so near that of
    two vectors at the threshold's angle on either side one at least is shown to the other's cell, so no pair is lost. Vectors at home in a cell are multiplied with the cell's members, block by block in
    double precision. A block gives link counts and a spanning forest, never its pairs; a large cell is several blocks a side.
    Vectors of another length than most link only among themselves. Rows that take no part (see vectors.valid), null ids
    included, have no links and are kept, each its own component. Rows with one id are one node.
    """
    fine = valid(df, id_col, vec_col)
    reps = stage(fine.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("mult")), "vectors")
    dims = reps.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = (dims[0].dim, dims[0]["count"]) if dims else (0, 0)
    centroids, reach = _fit(reps, n, dim, threshold) if n else (np.zeros((0, 0)), 1.0)
    k = len(centroids)
    width = reach * np.sqrt(1 - threshold**2)
    angle = float(threshold)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            size = whole["vec"].map(len)
            for d in sorted(set(size)):
                pdf = whole[size == d]
                yield from _members(pdf["id"].to_numpy(), pdf["mult"].to_numpy(), pdf["vec"], d, centroids if d == dim else None, width)

    kind = "dim int, cell int, id long, home int, own boolean, mult long, x binary, bits binary"
    members = stage(reps.mapInPandas(place, kind), "members")
    sizes = members.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("o"))
    sizes = sizes.select("dim", "cell", F.ceil(F.col("n") / MEMBER_BLOCK).cast("int").alias("mb"), F.ceil(F.col("o") / HOME_BLOCK).cast("int").alias("hb")).where("hb > 0")
    dealt = members.join(F.broadcast(sizes), ["dim", "cell"]) if k <= MAX_CELLS else members.join(sizes, ["dim", "cell"])
    block = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int")
    upto = lambda m: F.sequence(F.lit(0), F.col(m) - 1)
    left = dealt.where("own").select("*", F.lit(True).alias("left"), block("hb").alias("h"), F.explode(upto("mb")).alias("m"))
    right = dealt.withColumn("bits", F.lit(b"")).select("*", F.lit(False).alias("left"), F.explode(upto("hb")).alias("h"), block("mb").alias("m"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d, cell = int(key[0]), int(key[1])
        side = pdf["left"].to_numpy(bool)
        a, b = pdf[side], pdf[~side]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "n": [], "root": []}, dtype="int64")
        x = lambda p: np.frombuffer(b"".join(p["x"]), np.float64).reshape(len(p), d)
        bits = np.frombuffer(b"".join(a["bits"]), np.uint8).reshape(len(a), -1)
        return _links(x(a), a["id"].to_numpy(), bits, x(b), b["id"].to_numpy(), b["home"].to_numpy(), cell, a["mult"].to_numpy(), b["mult"].to_numpy(), angle)

    found = stage(left.unionByName(right).groupBy("dim", "cell", "h", "m").applyInPandas(compare, "id long, n long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = reps.join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("vec", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    taking = fine.join(known, "vec").select("id", "n_links", "component")
    part = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    out = df.where(F.col(id_col).isNull() | F.col(vec_col).isNull() | ~F.coalesce(part, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component"))
    both = taking.unionByName(out)
    return both.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
