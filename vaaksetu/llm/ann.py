"""Nearest neighbours: score-aware (anisotropic) product quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage
from .vectors import matrix, valid

#: Dimensions of a subspace; each has 16 codewords, so a code is four bits.
SUB = 2
#: Vectors on which codewords are fitted: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Inner products from this share of the largest possible one count when errors are weighed.
THRESHOLD = 0.2
#: Centroids that vectors are coded against.
CELLS = 256
#: Entries that are reranked for each query at first.
RERANK = 512
#: Rows of a block of candidates at most, and at least where that leaves tasks without work; rows of a block of queries.
CAND_BLOCK, LEAST_BLOCK, QUERY_BLOCK = 65_536, 2048, 4096


class Codes:
    """Codewords (subspaces, 16, SUB) under the loss |r|^2 + (eta - 1) (r . x / |x|)^2 of a residual r of x.

    eta > 1 penalises the part of the error parallel to x, which is what changes its inner product with
    the queries for which x matters.
    """

    def __init__(self, dim: int, threshold: float = THRESHOLD):
        self.dim, self.m = dim, -(-dim // SUB)
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        self.words = np.zeros((self.m, 16, SUB))

    def split(self, x: np.ndarray) -> np.ndarray:
        full = np.zeros((len(x), self.m * SUB))
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), self.m, SUB)

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.split(x)
        return s, s / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None, None]

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """A code in each subspace: first the nearest codeword, then, one subspace after the other, the one of least loss given the rest."""
        s, u = self._parts(x)
        plain = ((s[:, :, None, :] - self.words[None]) ** 2).sum(axis=3)
        along = (s * u).sum(axis=2)[:, :, None] - np.einsum("nmd,mkd->nmk", u, self.words)
        codes = plain.argmin(axis=2)
        rows = np.arange(len(x))
        now = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0]
        total = now.sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.m):
                rest = total - now[:, m]
                codes[:, m] = (plain[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                now[:, m] = along[rows, m, codes[:, m]]
                total = rest + now[:, m]
        return codes

    def fit(self, x: np.ndarray, rounds: int = 8, seed: int = 11) -> Codes:
        """Alternates coding and, for each subspace, the codewords of least loss given the other subspaces' codes."""
        rng = np.random.default_rng(seed)
        s, u = self._parts(x)
        self.words = np.stack([s[rng.choice(len(x), 16, replace=len(x) < 16), m] for m in range(self.m)])
        for _ in range(rounds):
            codes = self.encode(x, 1)
            coded = np.stack([self.words[m][codes[:, m]] for m in range(self.m)], axis=1)
            along = ((s - coded) * u).sum(axis=2)
            for m in range(self.m):
                rest = along.sum(axis=1) - along[:, m]
                want = s[:, m] + (self.eta - 1) * u[:, m] * (rest + (s[:, m] * u[:, m]).sum(axis=1))[:, None]
                outer = (self.eta - 1) * u[:, m, :, None] * u[:, m, None, :]
                for k in range(16):
                    mine = codes[:, m] == k
                    if mine.any():
                        self.words[m, k] = np.linalg.solve(mine.sum() * np.eye(SUB) + outer[mine].sum(axis=0), want[mine].sum(axis=0))
                along[:, m] = ((s[:, m] - self.words[m][codes[:, m]]) * u[:, m]).sum(axis=1)
        return self

    def pack(self, codes: np.ndarray) -> list[bytes]:
        even = np.zeros((len(codes), self.m + self.m % 2), np.uint8)
        even[:, : self.m] = codes
        return [r.tobytes() for r in even[:, ::2] | even[:, 1::2] << 4]

    def unpack(self, data: list[bytes]) -> np.ndarray:
        b = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
        return np.stack([b & 15, b >> 4], axis=2).reshape(len(data), -1)[:, : self.m]

    def scan(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with coded vectors, summed from each query's tables of 16 entries a subspace."""
        tables = np.einsum("qmd,mkd->qmk", self.split(q), self.words).astype(np.float32)
        out = np.zeros((len(q), len(codes)), np.float32)
        for m in range(self.m):
            out += tables[:, m][:, codes[:, m]]
        return out


class Cells:
    """What vectors are coded by: x is the nearest centroid plus a residual, whose length is kept and whose direction has codes.

    So vectors far from the origin, in dense groups or of very different lengths are told apart as well as others. Every entry is scanned,
    whatever its cell: centroids are for precision, not for pruning.
    """

    def __init__(self, sample: np.ndarray, seed: int = 11):
        self.mean = sample.mean(axis=0)
        self.scale = max(np.abs(sample - self.mean).max(), 1e-300)
        x = self.placed(sample)
        rng = np.random.default_rng(seed)
        self.centres = x[rng.choice(len(x), min(CELLS, max(1, len(x) // 32)), replace=False)]
        for _ in range(10):
            home = self.home(x)
            for c in np.unique(home):
                self.centres[c] = x[home == c].mean(axis=0)
        _, _, units = self.parts(x)
        self.codes = Codes(x.shape[1]).fit(units)

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Moved and scaled alike, which changes no order of distances; squares then stay in range."""
        return (x - self.mean) / self.scale

    def home(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - 0.5 * (self.centres**2).sum(axis=1)).argmax(axis=1)

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, length and direction of the residual."""
        home = self.home(x)
        rest = x - self.centres[home]
        size = np.sqrt((rest * rest).sum(axis=1))
        return home, size, rest / np.maximum(size, 1e-300)[:, None]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, length, half (what a vector's score is less by whatever the query) and codes."""
        home, size, units = self.parts(self.placed(vectors))
        codes = self.codes.encode(units)
        coded = np.stack([self.codes.words[m][codes[:, m]] for m in range(self.codes.m)], axis=1).reshape(len(units), self.codes.m * SUB)[:, : units.shape[1]]
        return home, size, size * (self.centres[home] * coded).sum(axis=1) + 0.5 * size**2, codes

    def near(self, queries: np.ndarray, home: np.ndarray, size: np.ndarray, half: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Half the squared distances of queries and coded vectors, as far as codes tell, with a minus."""
        q = self.placed(queries)
        far = 0.5 * ((q[:, None, :] - self.centres[None]) ** 2).sum(axis=2)
        return self.codes.scan(q, codes) * size - half - far[:, home]


def _scan(cells: Cells, q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, marks: tuple[np.ndarray, ...], rerank: int) -> Iterator[pd.DataFrame]:
    """The `rerank` coded vectors of a block that look nearest to each query; queries some at a time, so that what is held is bounded."""
    for i in range(0, len(q), 32):
        near = cells.near(q[i : i + 32], *marks)
        best = np.argpartition(-near, rerank - 1, axis=1)[:, :rerank] if rerank < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
        yield pd.DataFrame({"query_id": np.repeat(q_ids[i : i + 32], best.shape[1]), "rep": ids[best].ravel(), "near": np.take_along_axis(near, best, axis=1).ravel()})


def _shortlists(cells: Cells, coded: DataFrame, asked: DataFrame, dim: int, n: int, rerank: int) -> DataFrame:
    """(query_id, rep, place): for each query the `rerank` entries that its codes place nearest, place from 1."""

    def as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["query_id"], "data": [v.tobytes() for v in matrix(pdf["q"])] if len(pdf) else []})

    tasks = coded.sparkSession.sparkContext.defaultParallelism
    cb = max(-(-n // CAND_BLOCK), min(-(-n // LEAST_BLOCK), tasks))
    # What a block of queries finds comes as one table, so longer shortlists have fewer queries a block.
    qb = max(1, -(-asked.count() * min(rerank, -(-n // cb)) // (QUERY_BLOCK * RERANK)))
    block = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    upto = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    left = coded.select("id", "cell", "size", "half", "data", block(cb).alias("c"), upto(qb).alias("q"))
    right = asked.mapInPandas(as_bytes, "id long, data binary").select("id", none("int").alias("cell"), none("double").alias("size"), none("double").alias("half"), "data", upto(cb).alias("c"), block(qb).alias("q"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        query = pdf["half"].isna().to_numpy()
        a, b = pdf[query], pdf[~query].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.array([], "int64"), "rep": np.array([], "int64"), "near": np.array([], "float64")})
        marks = (b["cell"].to_numpy(np.int64), b["size"].to_numpy(), b["half"].to_numpy(), cells.codes.unpack(list(b["data"])))
        return pd.concat(_scan(cells, np.frombuffer(b"".join(a["data"]), np.float64).reshape(len(a), dim), a["id"].to_numpy(), b["id"].to_numpy(), marks, rerank))

    found = left.unionByName(right).groupBy("c", "q").applyInPandas(search, "query_id long, rep long, near double")
    # Entries that look alike are in no order of their ids.
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), F.xxhash64("rep"), "rep"))
    # An id that has several vectors stands for several entries.
    return found.withColumn("place", place).where(F.col("place") <= rerank).groupBy("query_id", "rep").agg(F.max("place").alias("place"))


def _nearest_of(index: DataFrame, asked: DataFrame, dim: int, n: int, k: int, rerank: int) -> DataFrame:
    """(query_id, rank, id, score): for each query of a dimension the k nearest ids of that dimension, but its own.

    Exact distances of a shortlist show whether it was long enough: where codes tell little, the nearest of it stand anywhere in it. Queries
    of which one stands in its second half are asked again with a list four times as long, at last with all entries.
    """
    sample = index.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toPandas()
    cells = Cells(matrix(sample["vec"]))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                home, size, half, codes = cells.encode(matrix(pdf["vec"].iloc[i : i + 4096]))
                yield pd.DataFrame({"id": pdf["rep"].iloc[i : i + 4096].to_numpy(), "cell": home, "size": size, "half": half, "data": cells.codes.pack(codes)})

    coded = stage(index.select("rep", "vec").mapInPandas(encode, "id long, cell int, size double, half double, data binary"), "coded")
    done = []
    while True:
        pairs = _shortlists(cells, coded, asked, dim, n, rerank).join(index.select("rep", "ids", "vec"), "rep").join(asked.select("query_id", "q"), "query_id")
        pairs = pairs.select("query_id", "ids", "place", _distance("q", "vec").alias("score")).select("query_id", F.explode("ids").alias("id"), "score", "place").where("id <> query_id")
        best = pairs.groupBy("query_id", "id").agg(F.min(F.struct("score", "place")).alias("b")).select("query_id", "id", "b.score", "b.place")
        best = stage(best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k), "nearest")
        if rerank >= n:
            return reduce(DataFrame.union, [*done, best.select("query_id", "rank", "id", "score")])
        # Fewer than k: what the list has is mostly the query's own.
        sure = best.groupBy("query_id").agg(F.max("place").alias("last"), F.count("*").alias("m")).where((F.col("last") <= rerank // 2) & (F.col("m") == k)).select("query_id")
        done.append(best.join(sure, "query_id").select("query_id", "rank", "id", "score"))
        asked = stage(asked.join(sure, "query_id", "left_anti"), "queries")
        if asked.isEmpty():
            return reduce(DataFrame.union, done)
        rerank *= 4


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    # Pairs are of one dimension.
    return pd.Series(np.sqrt(((matrix(a) - matrix(b)) ** 2).sum(axis=1)) if len(a) else [], dtype="float64")


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, the k nearest other rows by Euclidean distance, ties to the smaller id.

    Vectors are coded by their residual from a centroid, its length exactly. Equal vectors are one entry of the index, with the k + 1
    smallest ids that have them. Every entry is coded; centroids and codewords are fitted on a bounded sample, for each dimension that vectors have. Queries meet all
    entries of their dimension in blocks, of which only four-bit codes travel: a table scan picks `rerank` entries a query, more where these turn out to be too few,
    and they alone are joined with their vectors for exact distances. Rows that take no part (see vectors.valid)
    are neither queries nor candidates. A row isn't its own candidate, nor are rows with its id; rows that repeat an id and a vector count
    once; a repeated query id is asked with its smallest vector. An empty table gives an empty one.
    """
    spark = df.sparkSession
    rows = valid(df, id_col, vec_col)
    same = W.partitionBy("vec").orderBy("id")
    index = rows.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    index = stage(index.select(F.get("ids", F.lit(0)).alias("rep"), "ids", "vec", F.size("vec").alias("dim")), "index")
    asked = stage(valid(df.where(queries), id_col, vec_col).groupBy("id").agg(F.min("vec").alias("q")).select(F.col("id").alias("query_id"), "q", F.size("q").alias("dim")), "queries")
    dims = index.groupBy("dim").agg(F.count("*").alias("n")).join(asked.select("dim").distinct(), "dim").orderBy("dim").collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    ranked = reduce(DataFrame.union, [_nearest_of(index.where(F.col("dim") == d.dim), asked.where(F.col("dim") == d.dim), d.dim, d.n, k, rerank) for d in dims])
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
