from collections import Counter, defaultdict

from vaaksetu.llm import langid
from vaaksetu.llm.queries import QUERIES


def key(gram):
    """Characters from the highest bits down, the mark being 0."""
    return sum((0 if c == "_" else ord(c)) << langid.BITS * (2 - i) for i, c in enumerate(gram))


def plain_grams(text):
    c = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = f"_{w}_"
        c.update(g for n in (1, 2, 3) for i in range(len(w) - n + 1) if (g := w[i : i + n]) != "_")
    sums = Counter()
    for g, n in c.items():
        sums[key(g)] += n
    return sums


def test_grams(monkeypatch):
    for chunk in (1 << 20, 3):
        monkeypatch.setattr(langid, "_CHUNK", chunk)
        for text in ("Ab1 b", "12-_", "ÉÀ x\U00020000y  Straße İ", "a", ""):
            k, n = langid.count_grams(text)
            assert dict(zip(k.tolist(), n.tolist())) == plain_grams(text) and (k[1:] > k[:-1]).all()


def test_against_plain_profiles(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()
    rows = [(r.doc_id, r.text[:1500], r.lang) for r in src]
    rows += [(9001, None, "en"), (9002, "123 !!", "en"), (9003, "", None), (None, rows[0][1], rows[0][2]), rows[1], rows[1], (9004, "x" * 200_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sums = defaultdict(Counter)
    for i, t, lang in rows:
        if t and lang and langid.crc_fold(i) != 1:
            sums[lang].update(plain_grams(t))
    profiles = {k: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.TOP])} for k, c in sums.items()}
    assert langid.train_profiles(docs.where(~langid.held_out(docs.doc_id))) == profiles
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (langid.crc_fold(r.doc_id) == 1)
        ranks = [g for g, _ in sorted(plain_grams(r.text or "").items(), key=lambda x: (-x[1], x[0]))[: langid.TOP]]
        if not ranks:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {k: langid.out_of_place(ranks, p) for k, p in profiles.items()}
        assert far[r.lang_pred] == min(far.values())
        assert abs(r.score - (1 - far[r.lang_pred] / (langid.TOP * len(ranks)))) < 1e-12


def test_no_language(spark):
    docs = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.where("false")).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op8_langid"](spark, folder).join(docs, "doc_id").where("held_out").collect()
    assert len(out) > 250 and sum(r.lang == r.lang_pred for r in out) > 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_kept_rows_have_the_predicted_language(spark):
    src = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()
    wrong, none = [next(r for r in src if r.lang == k and langid.crc_fold(r.doc_id) != 1) for k in ("fr", "en")]
    rows = [(r.doc_id, r.text, "en" if r is wrong else None if r is none else r.lang, 1) for r in src] + [(9002, "123 !!", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    got = langid.keep_known(docs)
    assert got.columns == docs.columns
    lang = {r.doc_id: r.lang for r in got.collect()}
    assert lang == {r.doc_id: r.lang_pred for r in langid.identify(docs).collect() if r.lang_pred != "und"}
    assert lang[wrong.doc_id] == "fr" and lang[none.doc_id] == "en" and 9002 not in lang
