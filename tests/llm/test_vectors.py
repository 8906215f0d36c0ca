import numpy as np
import pytest
from pyspark.sql import functions as F

from vaaksetu.llm import ann, embed_dedup
from vaaksetu.llm.queries import QUERIES

from .test_simhash import brute_components

BAD = [(901, None), (902, []), (903, [0.0] * 8), (904, [1.0, None] + [1.0] * 6), (905, [float("nan")] + [1.0] * 7), (906, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
SCHEMA = "vec_id long, embedding array<float>, id string, vec int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2) for i, v in rows], SCHEMA)


def made(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(n // 3, n // 2):
        x[i] = x[i - n // 3] + 0.12 * rng.normal(size=dim)
    x[n // 2 : n // 2 + 30] = x[5]
    x[n // 2 + 30 : n // 2 + 40] = x[6] + 0.01 * rng.normal(size=(10, dim))
    return x.astype(np.float32)


def brute(ids, x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    order = np.argsort(ids)
    comp = brute_components(len(ids), lambda i, j: near[order[i], order[j]])
    return {int(ids[order[i]]): (int(near[order[i]].sum()), int(ids[order[c]])) for i, c in enumerate(comp)}


@pytest.mark.parametrize("cell,home,member", [(16, 4096, 8192), (40, 7, 11), (10_000, 50, 60)])
def test_components(spark, monkeypatch, cell, home, member):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", cell)
    monkeypatch.setattr(embed_dedup, "HOME_BLOCK", home)
    monkeypatch.setattr(embed_dedup, "MEMBER_BLOCK", member)
    x = made(3, 360)
    ids = np.random.default_rng(1).permutation(1000)[:360] + 1000
    want = brute(ids, x)
    rows = list(zip(ids.tolist(), x.tolist())) + BAD + [(950, [1.0, 2.0]), (951, [2.0, 4.0])]
    got = embed_dedup.embedding_components(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.id: (r.n_links, r.component) for r in got}
    assert {i: by[i] for i in want} == want
    assert all(by[i] == (0, i) for i, _ in BAD) and by[950] == (1, 950) and by[951] == (1, 950)
    assert all(r.kept == (r.id == r.component) for r in got if r.id is not None)


def test_components_of_nothing(spark):
    assert embed_dedup.embedding_components(table(spark, []).where("false")).count() == 0
    assert [(r.n_links, r.kept) for r in embed_dedup.embedding_components(table(spark, BAD[:2])).collect()] == [(0, True)] * 2


def test_driver_vectors(spark):
    folder = "/root/testdata/sf0.01"
    src = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want = brute(np.array([r.vec_id for r in src]), np.array([r.embedding for r in src], np.float32))
    assert {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op1_embed_dedup"](spark, folder).collect()} == want


def exact(rows, k=10):
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            d = sorted((float(np.sqrt(((np.asarray(w, np.float32).astype(float) - np.asarray(v, np.float32).astype(float)) ** 2).sum())), j) for j, w in rows if j != i)
            out[i] = d[:k]
    return out


@pytest.mark.parametrize("cand,query", [(8192, 1024), (50, 7)])
def test_nearest(spark, monkeypatch, cand, query):
    monkeypatch.setattr(ann, "CAND_BLOCK", cand)
    monkeypatch.setattr(ann, "QUERY_BLOCK", query)
    rows = list(zip(range(1, 361), made(4, 360).tolist()))
    got = ann.nearest(table(spark, rows + BAD + [(940, [1.0, 2.0])] + rows[:3]), F.col("vec_id") % 20 == 0, rerank=40).collect()
    want = exact(rows)
    assert {r.query_id for r in got} == set(want)
    hits = 0
    for i, near in want.items():
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == i)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({v for _, v in near} & {m[1] for m in mine})
    assert hits >= 0.95 * 10 * len(want)


def test_few_candidates_and_none(spark):
    rows = [(20, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (7, [0.0, 3.0, 0.0])]
    got = ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got] == [(20, 1, 2, 0.0), (20, 2, 3, 0.0), (20, 3, 7, round(10**0.5, 6))]
    assert ann.nearest(table(spark, rows).where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(table(spark, rows), F.col("vec_id") == 1).count() == 0


def test_parallel_error_weighs_more():
    x = np.random.default_rng(2).normal(size=(2000, 16))
    fit, plain = ann.Codes(16).fit(x), ann.Codes(16)
    plain.eta = 1.0
    plain.fit(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(c):
        codes = c.encode(x)
        r = x - np.stack([c.words[m][codes[:, m]] for m in range(c.m)], axis=1).reshape(len(x), -1)
        return np.abs((r * u).sum(axis=1)).mean()

    fit.eta = max(fit.eta, 2.0)
    assert along(fit) < along(plain)
    codes = fit.encode(x[:5])
    assert (fit.unpack(fit.pack(codes)) == codes).all()


def test_recall_on_driver_vectors(spark):
    folder = "/root/testdata/sf0.1"
    src = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in src]), np.array([r.embedding for r in src], np.float64)
    got = {}
    for r in QUERIES["op6_ann"](spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits, total = hits + len(set(best.tolist()) & got[int(ids[i])]), total + 10
    assert hits >= 0.9 * total
    print("recall", hits / total)


@pytest.mark.parametrize("kind", ["offset", "dense groups", "lengths", "one group"])
def test_recall_on_other_vectors(spark, kind):
    """Far from the origin, in dense groups and of very different lengths: recall stays; where codes tell nothing, the shortlist grows."""
    rng = np.random.default_rng(6)
    n, dim = 1200, 16
    x = rng.normal(size=(n, dim))
    if kind == "offset":
        x += 40
    elif kind == "dense groups":
        x = rng.normal(size=(4, dim))[np.arange(n) % 4] + 0.01 * x
    elif kind == "lengths":
        x *= np.exp(1.5 * rng.normal(size=(n, 1)))
    else:
        x = np.where(np.arange(n)[:, None] < n // 10, 100 * x, 1 + 1e-5 * x)
    rows = list(zip(range(1, n + 1), x.astype(np.float32).tolist()))
    got = {}
    for r in ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, rerank=32).collect():
        got.setdefault(r.query_id, []).append(r.score)
    want = exact(rows)
    assert set(got) == set(want)
    hits = sum(s <= want[i][-1][0] * (1 + 1e-12) for i in want for s in got[i])
    assert hits >= 0.97 * 10 * len(want)


def test_wide_vectors_displaced_towards_another_centroid(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 120)
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=(8, 384)))
    rows = [unit(centre[i % 8] + unit(rng.normal(size=384)) * 2.5) for i in range(800)]
    for i in range(8):
        for j in range(i):
            # Either side of the border, at a cosine of 0.955.
            mid, way = unit(centre[i] + centre[j] + 0.2 * unit(rng.normal(size=384))), unit(centre[i] - centre[j])
            rows += [unit(mid + 0.15 * way), unit(mid - 0.15 * way)]
    x = np.array(rows, np.float32)
    ids = np.arange(1, len(x) + 1)
    got = {r.id: (r.n_links, r.component) for r in embed_dedup.embedding_components(table(spark, list(zip(ids.tolist(), x.tolist())))).collect()}
    want = brute(ids, x)
    assert sum(n for n, _ in want.values()) >= 50 and got == want


def test_every_dimension_is_searched(spark):
    """Vectors are compared with those of their own dimension, however few there are; equal ones count by their ids."""
    rows = list(zip(range(1, 201), made(5, 200).tolist())) + [(940, [1.0, 2.0]), (943, [1.5, 2.0]), (944, [0.0, 2.0]), (945, [1.5, 2.0]), (945, [1.5, 2.0]), (960, [3.0, 0.0, 1.0])]
    got = {}
    for r in ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[940] == [(943, 0.5), (945, 0.5), (944, 1.0)] and 960 not in got and set(got) == {*range(20, 201, 20), 940}


def test_members_take_bounded_memory():
    """Vectors that are members of very many cells come in tables of bounded size, and the product with the centroids is never held whole."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    c = embed_dedup.unit(rng.normal(size=(2048, 16)))
    # Borders of one product held whole: 3000 x 2048 doubles are 49 MB.
    tracemalloc.start()
    rows = 0
    for t in embed_dedup._members(np.arange(3000), np.ones(3000, np.int64), pd.Series(list(x)), 16, c, 0.16):
        rows += len(t)
        assert len(t) <= embed_dedup.ROWS
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    u = embed_dedup.unit(x.astype(np.float64))
    dots, home = u @ c.T, (u @ c.T).argmax(axis=1)
    far = 0.16 * np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
    assert rows == (dots.max(axis=1)[:, None] - dots <= far[home]).sum() > 100 * embed_dedup.ROWS / 10
    assert peak < 45e6
