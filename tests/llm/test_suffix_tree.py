import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vaaksetu.llm import suffix_tree as st
from vaaksetu.llm.common import words_of
from vaaksetu.llm.queries import QUERIES

held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
tokens_of = lambda t: [*words_of(t), st.END]


class Plain:
    """The model from its definition, with tuples of tokens for contexts."""

    def __init__(self, texts, least=st.LEAST, depth=st.DEPTH):
        self.counts = counts = Counter(w for t in texts for w in t)
        self.n, self.depth = sum(counts.values()), depth
        self.nexts = nexts = defaultdict(Counter)
        for t in texts:
            for i in range(len(t)):
                for d in range(min(i, depth) + 1):
                    nexts[tuple(t[i - d : i])][t[i]] += 1
        self.kept, counted = {()}, {()}
        for c in sorted(nexts, key=len):
            q = nexts[c]
            n = sum(q.values())
            if c and n >= least and c[1:] in self.kept and c[:-1] in counted:
                counted.add(c)
                up = nexts[c[1:]]
                gain = sum(k * math.log(k / n / (up[a] / sum(up.values()))) for a, k in q.items())
                if gain >= len(q) * math.log(n) / 2:
                    self.kept.add(c)
        once = sum(k == 1 for k in counts.values())
        self.unseen = min(0.5, max(once, 1) / (self.n + 1))

    def p(self, past, a):
        out = (1 - self.unseen) * self.counts[a] / self.n if self.counts[a] else self.unseen
        for d in range(1, min(self.depth, len(past)) + 1):
            c = tuple(past[-d:])
            if c not in self.kept:
                break
            q = self.nexts[c]
            out = (q[a] + len(q) * out) / (sum(q.values()) + len(q))
        return out

    def score(self, t):
        return sum(math.log10(self.p(t[max(0, i - self.depth) : i], t[i])) for i in range(len(t)))


@pytest.mark.parametrize("hot, tokens", [(100_000, 2_000_000), (20, 2_000), (1, 500)])
def test_against_definition(spark, monkeypatch, hot, tokens):
    monkeypatch.setattr(st, "HOT_LEAST", hot)
    monkeypatch.setattr(st, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(st, "BUCKET_TOKENS", tokens)
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text[:800]) for r in src] + [(None, None), (5001, ""), (5002, "A\0b \x0b z"), (src[0].doc_id, src[0].text[:800]), (5003, "y" * 30_000)]
    rows += [(6000 + i, "one fish two fish red fish blue fish one fish two") for i in range(30)]
    rows += [(7000 + i, "the cat sat on mats" if i % 2 else "a dog sat on logs") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = st.score_documents(docs).collect()
    assert len(got) == len(rows)
    plain = Plain([tokens_of(t) for i, t in rows if not held(i)])
    assert len(plain.kept) > 8 and max(map(len, plain.kept)) == st.DEPTH
    texts = dict(rows)
    for r in got:
        words = tokens_of(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(words), plain.n)
        assert r.n_known == sum(plain.counts[w] > 0 for w in words)
        assert math.isclose(r.base_score, sum(math.log10((plain.counts[w] + 1) / (plain.n + len(plain.counts) + 1)) for w in words), rel_tol=1e-9)
        assert math.isclose(r.score, plain.score(words), rel_tol=1e-9), r.doc_id
    # Every distribution is proper over the tokens seen and the unseen one.
    for past in ([], [b"fish"], [b"red", b"fish"], [b"one", b"fish"], [b"zz", b"fish"]):
        assert math.isclose(sum(plain.p(past, w) for w in [*plain.counts, b"never seen"]), 1)
    assert st.score_documents(docs.where("false")).count() == 0


def test_nothing_to_learn_from(spark):
    only = [i for i in range(100) if held(i)][:2]
    got = st.score_documents(spark.createDataFrame([(i, "ab") for i in only], "doc_id long, text string")).collect()
    assert all((r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0) for r in got)


def test_blocks_and_gain(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    whole = {r.doc_id: r for r in QUERIES["op4_suffix_tree"](spark, folder).collect()}
    out = [r for r in whole.values() if r.held_out]
    assert len(whole) == 1000 and sum(r.score for r in out) > sum(r.base_score for r in out)
    monkeypatch.setattr(st, "BLOCK_TOKENS", 5000)
    again = {r.doc_id: r for r in QUERIES["op4_suffix_tree"](spark, folder).collect()}
    assert all(math.isclose(whole[i].score, again[i].score, rel_tol=1e-9) and math.isclose(whole[i].base_score, again[i].base_score, rel_tol=1e-9) for i in whole)
    print([round(sum(getattr(r, k) for r in out) / sum(r.n_tokens for r in out), 4) for k in ("base_score", "score")])
    assert np.isfinite([r.score for r in whole.values()]).all()
