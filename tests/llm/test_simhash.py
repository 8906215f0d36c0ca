import numpy as np
import pytest
import xxhash

from vaaksetu.llm import graph, simhash
from vaaksetu.llm.graph import connected_components
from vaaksetu.llm.simhash import fingerprint, fingerprint_links, simhash_components, simhash_dedup

SCHEMA = "doc_id long, text string, rep string, fp int, component string"


def brute_components(n, linked):
    part = list(range(n))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                part[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


def test_fingerprint_by_hand():
    h = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c d", "a b c")]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in [h[0], h[1], xxhash.xxh64_intdigest("c d a", 42), xxhash.xxh64_intdigest("d a b", 42), h[2]]) * 2 > 5)
    assert fingerprint("A b\tC d a\n b c") % 2**64 == want
    assert fingerprint(None) == fingerprint("") == fingerprint(" \x0b\x0c") == 0
    assert fingerprint("É x") % 2**64 == xxhash.xxh64_intdigest("É x", 42)


def test_long_text_is_whole():
    words = [f"w{i}" for i in range(150_000)]
    assert fingerprint(" ".join(words)) != fingerprint(" ".join(words[:140_000]))


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 50), (7, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 50, 50: 50}
    assert connected_components(e.where("a < 0")).count() == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_links_against_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            x = int(b) % 2**64
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(bit)
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    edges = fingerprint_links(spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, rep long"), block=block)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = brute_components(len(fps), lambda i, j: ((fps[i] ^ fps[j]) % 2**64).bit_count() <= 3)
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_documents(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, text), (3, text.upper()), (9, None), (8, ""), (8, ""), (7, "quite another text"), (None, text), (6, "alone")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    got = sorted((r.id or -1, r.component) for r in simhash_components(docs).collect())
    assert got == [(-1, 3), (3, 3), (5, 3), (6, 6), (7, 7), (8, 8), (8, 8), (9, 8)]
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 6, 7, 8]
    assert simhash_components(docs.where("doc_id > 99")).count() == 0


def test_repeated_id_joins_its_texts(spark):
    docs = spark.createDataFrame([(1, "one text here"), (2, "one text here"), (2, "some other text"), (4, "some other text")], "doc_id long, text string")
    assert {(r.id, r.component) for r in simhash_components(docs).collect()} == {(1, 1), (2, 1), (4, 1)}


def test_nothing_goes_through_the_driver(spark, monkeypatch):
    """Tables that grow with the corpus are never broadcast, however small their files look."""
    plans, staged = [], graph.stage
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(graph, "stage", lambda df, name: plan(df) or staged(df, name))
    monkeypatch.setattr(simhash, "stage", lambda df, name: plan(df) or staged(df, name))
    rows = [(i, f"text number {i // 3}") for i in range(60)] + [(5, "another"), (2, "another")]
    plan(simhash_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(plans) >= 4 and "SortMergeJoin" in "".join(plans) and not [p for p in plans if "Broadcast" in p]
