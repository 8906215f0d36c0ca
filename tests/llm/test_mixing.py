import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from vaaksetu.llm import mixing
from vaaksetu.llm.queries import ORACLE_SQL, QUERIES

from .oracle import same


def level(budget, caps, weights):
    """Water-filling by repeated passes: who can't give a share gives all, the others share again."""
    open_, out, left = set(caps), {}, Fraction(budget)
    while open_:
        total = sum(weights[k] for k in open_)
        short = {k for k in open_ if caps[k] <= left * weights[k] / total}
        if not short:
            return out | {k: left * weights[k] / total for k in open_}
        out |= {k: caps[k] for k in short}
        left -= sum(caps[k] for k in short)
        open_ -= short
    return out


@pytest.mark.parametrize("budget,epochs", [((1, 2), 1), ((7, 10), 4), ((3, 1), 2), ((9, 1), 4), ((1, 1000), 1)])
def test_against_passes(spark, monkeypatch, budget, epochs):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(i, "w " * (1 + (i * 7) % 23), f"d{i % 2}", f"l{i % 3 % 2}" if i % 5 else None, "s0" if i % 3 == 0 else f"s{i % 7}") for i in range(400)]
    rows += [(None, None, "d0", "l0", None), (7, "", None, None, None), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, n_tokens string")
    weights = {"d0": 3, "d0/l0": 2, "d1/l1/s2": 5, "d1/l1/s3": 0}
    levels = {"a": F.col("a"), "b": F.col("b"), "c": F.col("n_tokens")}
    got = [r.asDict() for r in mixing.mix(docs, levels, weights, budget, epochs, 5).collect()]
    assert len(got) == len(rows)
    tokens, members = defaultdict(int), defaultdict(list)
    for i, t, *path in rows:
        leaf, n = tuple(x or "none" for x in path), len((t or "").split())
        tokens[leaf] += n
        members[leaf].append((i, n))
    weigh = lambda p: weights.get("/".join(p), 1)
    live = [p for p in tokens if all(weigh(p[: d + 1]) for d in range(3))]
    share = {(): min(Fraction(sum(tokens[p] for p in live) * budget[0] // budget[1]), Fraction(epochs * sum(tokens[p] for p in live)))}
    for d in range(3):
        for parent in {p[:d] for p in live}:
            kids = {p[: d + 1] for p in live if p[:d] == parent}
            caps = {k: Fraction(epochs * sum(tokens[p] for p in live if p[: d + 1] == k)) for k in kids}
            share |= level(share[parent], caps, {k: weigh(k) for k in kids})
    used, by_leaf = defaultdict(int), defaultdict(list)
    for r in got:
        leaf = (r["a"], r["b"], r["c"])
        used[leaf] += r["used_tokens"]
        by_leaf[leaf].append(r)
    assert sum(used.values()) == share[()]
    for leaf in tokens:
        assert abs(used[leaf] - share.get(leaf, 0)) <= 3 * 4
        # Rows stand in the seeded order, whole epochs first, then a prefix.
        a, t = used[leaf], tokens[leaf]
        full = a // t if t else 0
        rest = a - full * t
        order = sorted(by_leaf[leaf], key=lambda r: (hashlib.md5(f"5:{full}:{'' if r['id'] is None else r['id']}".encode()).hexdigest(), r["n_tokens"]))
        for r in order:
            take = max(0, min(r["n_tokens"], rest))
            assert (r["full_epochs"], r["prefix_tokens"]) == (full, take)
            rest -= r["n_tokens"]


def test_documents_and_empty(spark):
    docs = spark.createDataFrame([(i, "a b c", "x", "e") for i in range(50)] + [(None, "", "x", "e")], "doc_id long, text string, s string, full string")
    kept = mixing.mix_documents(docs, {"s": F.col("s")}, {}, (1, 2))
    assert kept.columns == docs.columns and kept.count() == 26
    assert mixing.mix(docs.where("false"), {"s": F.col("s")}, {}).count() == 0


def test_sql(spark):
    assert same(spark, QUERIES["op3_mixing"], ORACLE_SQL["op3_mixing"], "/root/testdata/sf0.01") == 1000
