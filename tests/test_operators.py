import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaaksetu.operators import evaluation, lattice, manifest, spelling, taxonomy
from vaaksetu.plans import pipelines, reports
from vaaksetu.sources import audio, tables
from vaaksetu.streaming import transcripts

# An utterance with published rates.
SAID = {"A": "उसने 14 पुस्तकें खरीदी", "B": "उसने चौदह किताबे खरीदीं", "C": "उसने चौदह किताबें खरीदी"}


def test_lattice(spark):
    wide = lattice.demo_lattice(spark, "उसने चौदह किताबें खरीदीं", SAID)
    outputs = lattice.long_form(wide)
    bins = lattice.build_lattice(outputs).first().bins
    assert [set(b) for b in bins] == [{"उसने"}, {"चौदह", "14"}, {"किताबें", "किताबे", "कताबें", "कताबे"}, {"खरीदीं", "खरीदी", "ख़रीदीं"}]
    got = {r.model: (r.standard_wer, r.lattice_wer) for r in lattice.evaluate_models(wide).collect()}
    assert got == {"A": (0.75, 0.25), "B": (0.25, 0.0), "C": (0.25, 0.0)}
    assert "✓ Reduced" in reports.lattices(lattice.evaluate_models(wide))
    more = wide.union(spark.createDataFrame([("2", None, "x", "y", "z"), ("3", "nan", "x", "y", "z"), ("4", "।", "x", " ", "nan")], wide.schema))
    out = {r.model: r.standard_wer for r in lattice.evaluate_models(more).collect()}
    assert out["A"] == float("inf") and out["B"] == 0.25


def test_manifest(spark):
    recordings = spark.createDataFrame([(7, 1), (8, 2), (9, 3), (9, 4)], "user_id long, recording_id long")
    segments = '[{"start":0,"end":0.5,"text":" a "},{"start":0,"end":30.0,"speaker_id":5,"text":"b"},{"start":0,"end":0.49,"text":"c"},{"start":0,"end":30.01,"text":"d"},{"start":0,"end":2,"text":" "},{"start":0,"end":3}]'
    json = spark.createDataFrame([(1, segments), (2, "[{broken"), (4, segments)], "recording_id long, json string")
    here = spark.createDataFrame([(1,), (2,)], "recording_id long")
    got = manifest.build_manifest(manifest.with_paths(recordings), json, here).collect()
    assert [(r.recording_id, r.text, r.duration, r.speaker_id, r.audio_path) for r in got] == [(1, "a", 0.5, 7, "1_audio.wav"), (1, "b", 30.0, 5, "1_audio.wav")]
    rows, stats = pipelines.segments(recordings, json)
    assert stats.first().n_segments == 4 and rows.where("false").count() == 0


def predictions(spark, n=120):
    rows = [(i, f"दो लोग {i} घर", f"2 लोग {i}", f"2 लोग {i} घर" if i % 3 else f"दो लोग {i} घर") for i in range(n)]
    table = lambda k: spark.createDataFrame([(r[0], r[k]) for r in rows], "index int, text string")
    return table(1), table(2), table(3)


def test_recognition_errors(spark, tmp_path):
    out = pipelines.recognition_errors(*predictions(spark))
    p = out["predictions"]
    assert p.count() == 120 and p.where("finetuned_wer > 0").count() == 80
    s = taxonomy.sample_errors(p)
    assert [r["index"] for r in s.orderBy("sample_rank").collect()] == [i for i in range(120) if i % 3][::3][:25]
    assert out["taxonomy"].first().category == "Number Format Mismatch" and out["taxonomy"].first().n == 25 and len(out["taxonomy"].first().examples) == 5
    assert out["fixes"].count() == 10 and out["report"].count() == 2
    tables.write_csv(p, f"{tmp_path}/p")
    assert sorted(map(tuple, tables.read_predictions(spark, f"{tmp_path}/p").collect())) == sorted(map(tuple, p.collect()))
    assert "Number Format Mismatch" in reports.errors(p) and "Pretrained" in reports.wer(p, {"pretrained": 1.0})
    impact = {r.step: r.wer for r in pipelines.cleanup_impact(p.select("reference", F.col("finetuned_prediction").alias("prediction"))).collect()}
    assert impact["raw"] > 0 and set(impact) == {"raw", "clean", "numbers", "tags", "both"}


def test_training_wer(spark):
    rows = spark.createDataFrame([([5, 6, -100], [5, 7, 0]), ([8], [8])], "labels array<int>, predictions array<int>")
    assert evaluation.training_wer(rows).first().wer == pytest.approx(100 / 3)


def test_spelling_lists(spark):
    words = spark.createDataFrame([("है",), ("है ",), (None,), (" ",), ("बजत",), ("है",)], "w string")
    out = pipelines.spell_check(words, ["है"])
    assert sorted(r.word for r in out["words"].collect()) == ["बजत", "है", "है"]
    assert {r.confidence: r.n for r in out["confidence"].collect()} == {"high": 2, "medium": 0, "low": 1}
    assert out["review"].count() == 1 and "बजत" in reports.spellings(out["words"])
    d = spelling.loan_density(spark.createDataFrame([(1, "जॉब और जॉब टिकट")], "doc_id long, text string")).first()
    assert (d.total_words, d.english_words, [(w.word, w["count"]) for w in d.top_words]) == (4, 3, [("जॉब", 2), ("टिकट", 1)])
    e = spelling.loan_density(spark.createDataFrame([], "doc_id long, text string")).first()
    assert (e.total_words, e.english_ratio) == (0, 0.0)


def test_split_is_exact(spark):
    rows = spark.createDataFrame([(i,) for i in range(237)], "id long")
    assert {r.split: r["count"] for r in manifest.exact_split(rows, "id", 10).groupBy("split").count().collect()} == {"eval": 24, "train": 213}


def wav(seconds, rate=8000, channels=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.ones(int(seconds * rate) * channels) * 16384).astype("<i2").tobytes())
    return out.getvalue()


def test_audio(spark):
    x = audio.read_range(wav(2), 0.5, 1.5)
    assert len(x) == 16000 and np.allclose(x, 0.5, atol=1e-3) and audio.read_range(b"junk", 0, 1) is None
    rows = spark.createDataFrame([("a", 0.0, 1.0, "घर!", 1), ("a", 0.0, 0.4, "x", 1), ("b", 0.0, 1.0, "x", 2), ("a", 0.0, 1.0, "!", 3)], "audio_path string, start double, end double, text string, recording_id long")
    files = spark.createDataFrame([("a", wav(2)), ("b", b"junk")], "audio_path string, content binary")
    data = audio.build_dataset(rows, files)
    assert [(r.text, r.duration, r.audio.sampling_rate) for r in data.collect()] == [("घर", 1.0, 16000)]
    said = audio.run_inference(data.withColumn("index", F.lit(1)), lambda: lambda batch: [f" {len(b)} " for b in batch])
    assert said.first().text == "16000"
    f = audio.features(data, lambda x: x[:4].reshape(2, 2), lambda t: [len(t)]).first()
    assert len(f.input_features) == 2 and f.labels == [2]


def test_sources(spark, tmp_path):
    (tmp_path / "5_transcription.json").write_text('[{"start":0,"end":1,"text":"x"}]')
    assert [tuple(r) for r in tables.read_transcripts(spark, str(tmp_path)).collect()] == [(5, '[{"start":0,"end":1,"text":"x"}]')]
    built = []
    for _ in range(2):
        t = tables.cached(spark, f"{tmp_path}/cache", lambda: built.append(1) or spark.range(3).toDF("id"))
    assert t.count() == 3 and len(built) == 1
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "u string, d string")
    assert {r.u: r.ok for r in tables.fetch_all(rows, "u", "d", lambda u, d: 1 / (u == "a") > 0).collect()} == {"a": True, "b": False}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a b", "a c", "2024-01-01 00:00:00"), ("a", "a", "2024-01-01 00:01:00")], "reference string, prediction string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = transcripts.rolling_wer(stream, "ts").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.edits, r.words) for r in spark.table("rates").collect()] == [(1, 3)]
    b = transcripts.for_each_batch(stream, lambda d: d.select("reference"), f"{tmp_path}/out", f"{tmp_path}/cp")
    b.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_exact_quantiles(spark):
    import random

    rng = random.Random(6)
    for values in ([], [3.0], [1.0, 2.0], [-5.0, 0.0, 0.0, 7.5], [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-3, 6) for _ in range(501)] + [0.25] * 300):
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        shares = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}
        got = manifest.exact_quantiles(rows, "v", shares).first()
        for name, p in shares.items():
            assert got[name] == (pytest.approx(float(np.quantile(values, p)), rel=1e-12) if values else None), (name, len(values))


def test_speaker_is_named_or_not(spark):
    json = '[{"start":0,"end":1,"text":"a"},{"start":0,"end":1,"speaker_id":null,"text":"b"},{"start":0,"end":1,"speaker_id":4,"text":"c"}]'
    got = manifest.build_manifest(spark.createDataFrame([(7, 1, "x")], "user_id long, recording_id long, audio_path string"), spark.createDataFrame([(1, json)], "recording_id long, json string"))
    assert {r.text: r.speaker_id for r in got.collect()} == {"a": 7, "b": None, "c": 4}


def test_split_of_an_empty_table(spark):
    assert manifest.exact_split(spark.createDataFrame([], "id long"), "id").count() == 0


def test_audio_ranges_of_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(2))
    rows = spark.createDataFrame([(str(tmp_path / "a.wav"), 0.5, 1.5, "x", 1), (f"file://{tmp_path}/a.wav", 0.0, 1.0, "y", 2), (str(tmp_path / "none.wav"), 0.0, 1.0, "z", 3)], "audio_path string, start double, end double, text string, recording_id long")
    assert {(r.text, r.duration) for r in audio.build_dataset(rows).collect()} == {("x", 1.0), ("y", 1.0)}


def test_download(tmp_path):
    (tmp_path / "from").write_text("x")
    to = tmp_path / "to"
    assert tables.download(f"file://{tmp_path}/from", str(to)) and to.read_text() == "x"
    to.write_text("kept")
    assert tables.download(f"file://{tmp_path}/from", str(to)) and to.read_text() == "kept"


def test_white_space_survives_csv(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(" a ",), ("b\n\"c\", d",)], "w string"), f"{tmp_path}/w")
    assert {r.w for r in tables.read_csv(spark, f"{tmp_path}/w").collect()} == {" a ", 'b\n"c", d'}


def test_audio_is_never_broadcast(spark):
    """Files' contents don't pass through the driver, whatever the estimate of their table's size; batches of them are bounded."""
    from vaaksetu.plans.catalog_data import recorded
    from vaaksetu.sources import audio

    data = audio.build_dataset(*recorded(spark, "/root/testdata/sf0.001"))
    plan = data._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 64 << 20


def test_only_distinct_words_are_classified(spark):
    """A filter on the class stays above the grouping, so that no row is classified before it."""
    from vaaksetu.operators import spelling

    words = spark.createDataFrame([("लोग",), ("लोग",), ("xyz",), (" ",), (None,)], "w string")
    rows = spelling.classify_list(words).where("confidence = 'high'")
    below = rows._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1].split("\n", 1)[1]
    assert "CASE" not in below
    assert {r.word for r in rows.collect()} == {"लोग", "xyz"}


def test_numbers_take_their_text_once(spark):
    """What the text is made by is worked out once a row, and the pattern of runs isn't compiled for each."""
    from pyspark.sql import functions as F

    from vaaksetu.functions.numbers import normalize_numbers

    rows = spark.createDataFrame([("दो सौ घर पच्चीस",), ("घर",), ("दो",), ("घर दो",), ("",), (None,)], "t string")
    out = rows.select(normalize_numbers(F.translate("t", "☂", "")).alias("n"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("☂") == 1 and "सौ" not in plan.split("split(")[1].split(")")[0]
    assert [r.n for r in out.collect()] == ["200 घर 25", "घर", "2", "घर 2", "", None]


def test_batches_of_alignments(spark):
    """Pairs of a batch are aligned together, with the steps of one pair alone; whatever reads a table has bounded batches."""
    import numpy as np

    from vaaksetu.operators.alignment import align, align_words
    from vaaksetu.plans.registry import read

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    read(spark, "/root/testdata/sf0.001", "conversations")
    assert int(spark.conf.get(key)) <= 64 << 20
    rng = np.random.default_rng(1)
    said = lambda n: None if n == 13 else [str(x) for x in rng.integers(0, 4, size=n)]
    rows = [(i, said(int(rng.integers(0, 14))), said(int(rng.integers(0, 14)))) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, r array<string>, h array<string>").select("i", align("r", "h").alias("ops")).collect()
    want = {i: None if r is None or h is None else align_words(r, h) for i, r, h in rows}
    assert {g.i: None if g.ops is None else [tuple(o) for o in g.ops] for g in got} == want


def test_a_lattice_takes_one_grouping(spark):
    """Votes, numbers of models and references come from one grouping by segment; nothing is joined, nor broadcast when models are scored."""
    from vaaksetu.operators import lattice

    rows = [("1", f"m{i}", ["क", "ख"], h) for i, h in enumerate([["क", "ग"], ["क", "ग"], ["घ"], ["क", "ख", "च"]])]
    outputs = spark.createDataFrame(rows, "segment string, model string, ref array<string>, hyp array<string>")
    built = lattice.build_lattice(outputs, expand=False)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    assert built.collect()[0].bins == [["क"], ["ख", "ग"]]
    assert "Broadcast" not in lattice.score_models(outputs, built)._jdf.queryExecution().executedPlan().toString()


def test_a_report_works_its_samples_out_once(spark, monkeypatch):
    from vaaksetu.operators import evaluation
    from vaaksetu.plans import catalog_errors, reports

    plans, means = [], evaluation.fix_means
    monkeypatch.setattr(evaluation, "fix_means", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or means(df))
    reports.errors(catalog_errors.predictions(spark, "/root/testdata/sf0.001"))
    assert len(plans) == 1 and "Join" not in plans[0] and "Relation" not in plans[0].replace("LocalRelation", "")
