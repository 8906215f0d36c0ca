import random

import numpy as np
import pytest

from vaaksetu.llm import passages as ps

rng = random.Random(3)
fresh = lambda n, tag: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


def edited(words, every):
    out = list(words)
    for i in range(every // 2, len(out), every):
        out[i] = f"edit{rng.randrange(10**6)}"
    return out


def test_seed_in_every_window():
    h = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    mers, pos = ps.seeds_of(h)
    assert (np.diff(pos) <= ps.WINDOW).all() and pos[0] < ps.WINDOW and pos[-1] >= len(h) - ps.K + 1 - ps.WINDOW
    again, shifted = ps.seeds_of(np.concatenate([h[:7] + np.uint64(1), h]))
    assert set(mers[(pos > ps.WINDOW)].tolist()) <= set(again.tolist())
    assert len(ps.seeds_of(h[:4])[0]) == 0 and len(ps.seeds_of(h[:5])[0]) == 1


def best_score(pairs):
    pairs = sorted(set(pairs))
    f = []
    for i, (p, q) in enumerate(pairs):
        f.append(ps.WORTH + max([0.0] + [f[j] - ps.GAP_COST / 2 * (p - a + q - b) for j, (a, b) in enumerate(pairs[:i]) if a < p and b < q]))
    return max(f)


@pytest.mark.parametrize("seed", range(6))
def test_chain_is_optimal(seed):
    r = random.Random(seed)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(60)]
    got = ps.chains(pairs, 1)
    assert sorted(x for c in got for x in c) == sorted(set(pairs))
    for c in got:
        assert all(a < b and x < y for (a, x), (b, y) in zip(c, c[1:]))
    value = lambda c: ps.WORTH * len(c) - ps.GAP_COST / 2 * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1])
    assert max(map(value, got)) == pytest.approx(best_score(pairs))


def test_planted(spark):
    p, q = fresh(60, "p"), fresh(80, "q")
    line = fresh(20, "line")
    rows = {
        1: fresh(100, "a") + p + fresh(30, "a"), 2: fresh(40, "b") + p + fresh(10, "b"), 3: p, 4: fresh(10, "d") + edited(q, 25) + fresh(300, "d"),
        5: fresh(500, "e") + q + fresh(5, "e"), 6: fresh(200, "f") + line, 7: line + fresh(90, "g"), 8: fresh(400, "h"), 9: fresh(70, "i") + p[:30] + fresh(70, "i"),
        10: fresh(20_000, "j") + q + fresh(100, "j") + p, 11: edited(p, 4) + fresh(50, "k"),
    }
    docs = [(i, " ".join(w), "x", 1) for i, w in rows.items()] + [(12, None, "x", 1), (13, "", "x", 1), (None, " ".join(p), "x", 1), (3, " ".join(p), "y", 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, h string, pos int")
    got = ps.repeated_passages(df).collect()
    links = {(r.doc_id, r.partner_id) for r in got}
    # 10 repeats q unedited: its seeds that 4 edited away have 5 for their anchor.
    assert links - {(10, 5)} == {(2, 1), (3, 1), (5, 4), (10, 4), (10, 1)}
    by = {(r.doc_id, r.partner_id): r for r in got}
    assert (by[2, 1].start, by[2, 1].end, by[2, 1].partner_start, by[2, 1].partner_end, by[2, 1].similarity) == (40, 100, 100, 160, 1.0)
    assert abs(by[5, 4].start - 500) <= 13 and abs(by[5, 4].end - 580) <= 13 and by[5, 4].similarity >= 0.9
    assert ps.repeated_passages(df.where("doc_id > 99")).count() == 0


def test_insertions_and_deletions():
    a = np.arange(200, dtype=np.uint32)
    b = np.concatenate([a[:60], [900, 901], a[60:100], a[103:200]])
    chain = [(20, 20), (50, 50), (70, 72), (130, 129)]
    s, e, t, u, kept, more = ps.align(a, b, chain)
    assert (s, e, t, u) == (0, 200, 0, 199) and kept == 197 and more


def test_group_of_copies_is_a_star(spark):
    text = fresh(120, "w")
    docs = spark.createDataFrame([(i, " ".join(edited(text, 60))) for i in range(40)], "doc_id long, text string")
    got = ps.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} | {r.partner_id for r in got} == set(range(40))
    assert len(got) <= 4 * 40


def test_run_of_lines_first_seen_elsewhere(spark):
    """Two later documents share three lines in a row, each of which earlier documents have elsewhere: 20 such pairs, all found."""
    rows, want = [], set()
    for g in range(20):
        lines = [fresh(20, f"line{g}") for _ in range(3)]
        for n in range(6):
            rows.append((100 * g + n, fresh(40, "a") + lines[n % 3] + fresh(40, "a")))
        # One more has the first two lines together, one the last two.
        rows += [(100 * g + 6, fresh(30, "b") + lines[0] + lines[1] + fresh(9, "b")), (100 * g + 7, lines[1] + lines[2] + fresh(30, "b"))]
        rows += [(100 * g + 8, fresh(50, "c") + sum(lines, []) + fresh(50, "c")), (100 * g + 9, fresh(60, "d") + sum(lines, []) + fresh(70, "d"))]
        want.add((100 * g + 9, 100 * g + 8))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = ps.repeated_passages(docs).collect()
    assert {(r.doc_id, r.partner_id) for r in got} == want
    assert all(r.start <= 60 and r.end >= 120 and r.similarity >= 0.9 for r in got)


def test_passage_made_of_known_parts(spark):
    """A passage that two documents have word for word, whose parts earlier documents have one each."""
    parts = [fresh(40, f"part{i}") for i in range(3)]
    rows = {i + 1: fresh(30, "x") + p + fresh(30, "x") for i, p in enumerate(parts)}
    rows |= {100: fresh(20, "y") + sum(parts, []) + fresh(20, "y"), 101: fresh(55, "z") + sum(parts, []) + fresh(5, "z")}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = ps.repeated_passages(docs).collect()
    assert [(r.doc_id, r.partner_id, r.start, r.end, r.partner_start, r.partner_end, r.similarity) for r in got] == [(101, 100, 55, 175, 20, 140, 1.0)]


def test_long_passage_is_aligned_whole(spark):
    """Words agree far beyond the chain's reach where their seeds have another anchor."""
    body = fresh(900, "w")
    docs = spark.createDataFrame([(1, " ".join(body[:400])), (2, " ".join(body)), (3, " ".join(fresh(10, "v") + body))], "doc_id long, text string")
    got = {(r.doc_id, r.partner_id): (r.start, r.end) for r in ps.repeated_passages(docs).collect()}
    assert got[2, 1] == (0, 400) and got[3, 1] == (10, 410) and got[3, 2] == (10, 910)


def best_shared(a, b, similarity=0.8, least=50):
    """Whether some stretches of `least` words or more in both texts keep the share `similarity` of the longer one: windows of `least` words, by edit distance."""
    from itertools import product

    where = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    shifts = {}
    for i, w in enumerate(a):
        for j in where.get(w, ()):
            shifts[i - j] = shifts.get(i - j, 0) + 1
    for shift, n in shifts.items():
        if n < similarity * least * 0.4:
            continue
        same = [0]
        for i in range(max(0, shift), min(len(a), len(b) + shift)):
            same.append(same[-1] + (a[i] == b[i - shift]))
        if any(same[i + least] - same[i] >= similarity * least for i in range(len(same) - least)):
            return True
    return False


@pytest.mark.parametrize("share,recall", [(0.05, 0.97), (0.10, 0.9), (0.15, 0.75)])
def test_recall_against_all_pairs(spark, share, recall):
    """Of all pairs of documents that brute force finds similar stretches in, how many the query joins: directly or through a star's middle."""
    r = random.Random(int(share * 100))
    rows, n = [], 0
    for g in range(30):
        p = fresh(r.randrange(56, 90), f"g{g}_")
        for _ in range(3):
            rows.append((n, fresh(r.randrange(60), "o") + [w if r.random() >= share / 2 else f"e{r.randrange(10**6)}" for w in p] + fresh(r.randrange(60), "o")))
            n += 1
    want = {(j, i) for i in range(n) for j in range(i + 1, n) if i // 3 == j // 3 and best_shared(rows[j][1], rows[i][1])}
    got = ps.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    links = {(x.doc_id, x.partner_id) for x in got}
    near = {i: {i} for i in range(n)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    hit = sum(bool(near[a] & near[b]) for a, b in want)
    print(f"edits {share}: {len(want)} pairs, recall {hit / len(want):.3f}")
    assert hit >= recall * len(want) and all(a // 3 == b // 3 for a, b in links)


def test_anchor_has_only_a_part(spark):
    """Two documents share 54 words of which an earlier one has 46, so all seeds have the earlier one for their anchor: 40 such groups, all found."""
    rows, want = [], set()
    for g in range(40):
        run = fresh(54, f"run{g}")
        rows += [(10 * g, fresh(30, "a") + run[4:50] + fresh(30, "a")), (10 * g + 1, fresh(40, "b") + run + fresh(20, "b")), (10 * g + 2, fresh(7, "c") + run + fresh(50, "c"))]
        want.add((10 * g + 2, 10 * g + 1, 7, 61, 40, 94))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = ps.repeated_passages(docs).collect()
    assert {(r.doc_id, r.partner_id, r.start, r.end, r.partner_start, r.partner_end) for r in got} == want


def test_window_hashes():
    h = np.random.default_rng(2).integers(0, 2**63, 300).astype(np.uint64)
    a, b = ps.window_hashes(h, 50), ps.window_hashes(np.concatenate([h[100:103], h[:200]]), 50)
    assert len(a) == 251 and len(np.unique(a)) == 251 and (b[3:] == a[:151]).all() and len(ps.window_hashes(h[:49], 50)) == 0


class Counted(int):
    """A word that counts how often it is compared."""

    asked = 0

    def __eq__(self, other):
        Counted.asked += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def kept_plainly(a, b):
    row = [(j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, 0)]
        for j, y in enumerate(b, 1):
            (c, k), (up, left) = row[j - 1], (row[j], new[-1])
            new.append(min((c, k - 1) if x == y else (c + 1, k), (up[0] + 1, up[1]), (left[0] + 1, left[1])))
        row = new
    return -row[-1][1]


def test_little_work_for_few_edits(monkeypatch):
    """Ends that agree aren't aligned, and matches that all ascend don't ask the tree; results are those of the plain ways."""
    a = list(map(Counted, range(45)))
    b = list(map(Counted, [*range(20), 99, 98, *range(21, 45)]))
    Counted.asked = 0
    assert ps._same(a, b) == 44 and Counted.asked < 200
    r = random.Random(5)
    for _ in range(500):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        assert ps._same(a, b) == kept_plainly(a, b)
    for n, w in ((1, 1), (5, 5), (40, 12), (300, 12)):
        v = np.random.default_rng(n).integers(0, 9, n).astype(np.uint64)
        assert ps.least_places(v, w).tolist() == [i + int(v[i : i + w].argmin()) for i in range(n - w + 1)]
    ascending = [(3 * i, 4 * i + (i > 30)) for i in range(60)]
    assert max(len(c) for c in ps.chains(ascending)) == 60
    monkeypatch.setattr(ps.Fenwick, "raise_to", None)
    assert max(len(c) for c in ps.chains(ascending)) == 60
