import re

import corpus_pipeline as cp
from vaaksetu.llm import mixing, pieces, secrets

from .test_secrets import plain
from .test_simhash import brute_components


def five_words(text):
    """The set of five-word shingles of a text, a shorter text being one."""
    words = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text).strip("\x20\x09\x0a\x0b\x0c\x0d"))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs):
    """Doc ids and texts after each stage, the mixture apart."""
    known = [d for d in docs if d.text and any(c.isalpha() for c in d.text)]
    known.sort(key=lambda d: d.doc_id)
    sets = [five_words(d.text) for d in known]
    comp = brute_components(len(known), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    first = [d for i, d in enumerate(known) if comp[i] == i]
    out = {}
    for d in first:
        text, at = "", 0
        for s, k, e in plain(d.text):
            if k != secrets.ORDER["endpoint"]:
                if s >= at:
                    text += d.text[at:s] + "[SECRET]"
                at = max(at, e)
        out[d.doc_id] = text + d.text[at:]
    return out


def test_run_against_brute_force(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    extra = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "123 456 !!", "en", "src1", 9), (9003, "", None, None, 0), (9004, "some words pwd: abcd12 login=bob", None, "src3", 20)], src.schema)
    src.unionByName(extra).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    want = brute(docs)
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in cp.STAGES[:3]:
        columns = got.columns
        got = step(spark, got, str(tmp_path))
        assert got.columns == columns
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)
    last = cp.run(spark, str(tmp_path)).collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert 0 < len(last) < len(want) and len({r.doc_id for r in last}) == len(last)
    assert all(r.piece_ids == sp.encode(want[r.doc_id]) and r.decoded for r in last)
    total = sum(len(t.split()) for t in want.values())
    used = sum(len(want[r.doc_id].split()) for r in last)
    budget = total * mixing.BUDGET[0] // mixing.BUDGET[1]
    # Prefixes are rounded up to whole documents, one a leaf.
    assert budget <= used
    assert re.fullmatch(r"\w+", cp.STAGES[0][0])
