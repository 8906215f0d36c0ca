import random

import corpus_pipeline as cp
from vaaksetu.llm import jaccard
from vaaksetu.llm.jaccard import near_components, shingles
from vaaksetu.llm.simhash import fingerprint

from .test_simhash import brute_components

rng = random.Random(11)
fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]


def brute(rows):
    """The smallest id reachable by pairs of similarity 0.8, all pairs compared on their words."""
    sets = [set(zip(*[w[i:] for i in range(5)])) if len(w := (t or "").lower().split()) >= 5 else {tuple(w)} if w else set() for _, t in rows]
    linked = lambda i, j: rows[i][0] == rows[j][0] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    return {rows[i][0]: rows[c][0] for i, c in enumerate(brute_components(len(rows), linked))}


def edited(words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randrange(10**6)}"
    return out


def test_components_against_all_pairs(spark):
    texts = [fresh(n) for n in (150, 200, 300, 500, 9, 5, 3)]
    # Edits give similarities on either side of 0.8; chains link what isn't alike itself.
    rows = [w for t in texts for w in [t, t] + [edited(t, k) for k in range(1, 1 + len(t) // 25) for _ in range(3)]]
    line = fresh(30)
    rows += [fresh(8) + line * 40 + fresh(8) for _ in range(6)] + [line + fresh(9) for _ in range(30)] + [line + fresh(2) for _ in range(10)]
    base = fresh(200)
    rows += [edited(base, rng.randrange(1, 6)) for _ in range(80)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(1000, None), (1001, ""), (1002, " ".join(rows[3]).upper())]
    rows += [(1003, rows[5][1]), (1003, rows[90][1])]
    rows.sort()
    df = spark.createDataFrame(rows + [(None, "x y")], "doc_id long, text string")
    assert {r.id: r.component for r in near_components(df).collect()} == brute(rows)
    assert near_components(df.where("doc_id > 5000")).count() == 0


def test_stage_drops_edited_copies(spark):
    """Four substituted words in 200: 5-word similarity about 0.82. All links of 0.8 and more are found."""
    rows = []
    for i in range(40):
        w = fresh(200)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(edited(w, 4)))]
    want = brute(rows)
    assert sum(want[i] != i for i, _ in rows) >= 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()} == {i for i, _ in rows if want[i] == i}


def test_driver_documents(spark):
    src = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").collect()]
    src.sort()
    got = near_components(spark.createDataFrame(src, "doc_id long, text string")).collect()
    assert {r.id: r.component for r in got} == brute(src)
    assert len(shingles("a b")) == 1 and len(shingles("a b c d e f")) == 2


def test_stage_goes_through_simhash(spark, monkeypatch):
    """Fingerprints of 5-word shingles give the candidates; what only fingerprints call alike is not linked."""
    found, plain = [], jaccard.fingerprint_links
    monkeypatch.setattr(jaccard, "fingerprint_links", lambda reps, distance: found.append((reps.count(), plain(reps, distance).count())) or plain(reps, distance))
    w, line = fresh(800), fresh(30)
    rows = [(0, w), (1, edited(w, 1)), (2, fresh(90)), (3, fresh(12) + line * 60 + fresh(12)), (4, fresh(12) + line * 60 + fresh(12)), (5, fresh(3) + line * 60)]
    rows = [(i, " ".join(t)) for i, t in rows]
    want = brute(rows)
    assert want[1] == 0 and want[4] == 4 and fingerprint(rows[3][1], 5) != 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()} == {i for i, _ in rows if want[i] == i}
    ((n, edges),) = found
    assert n == len({fingerprint(t, 5) for _, t in rows}) and edges >= 1
