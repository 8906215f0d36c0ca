"""Queries on manifests, files and batches: recordings made from the tables' rows, written where an operator reads files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest
from ..sources import audio, tables
from . import pipelines
from .registry import query, read, scratch

#: A customer's recording has three segments: from 0, of a length that its key sets, named, null or missing speaker; one blank; one without text.
_LENGTH = "(k % 67) * 0.5::DOUBLE"


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select((k * 10).alias("user_id"), k.alias("recording_id"), F.concat(F.lit("http://old/x/"), k.cast("string")).alias("rec_url"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON whose key is there, null or missing, and every eleventh one broken."""
    k = F.col("c_custkey")
    speaker = F.when(k % 3 == 0, F.format_string('"speaker_id":%d,', k)).when(k % 3 == 1, '"speaker_id":null,').otherwise("")
    first = F.concat(F.lit('{"start":0,"end":'), ((k % 67) * 0.5).cast("string"), F.lit(","), speaker, F.lit('"text":" said '), k.cast("string"), F.lit(' "}'))
    second = F.concat(F.lit('{"start":1.5,"end":'), (2 + (k % 5) * 0.125).cast("string"), F.lit(',"text":"'), F.when(k % 4 == 0, " ").otherwise("more"), F.lit('"}'))
    whole = F.concat(F.lit("["), first, F.lit(","), second, F.lit(',{"start":0,"end":9}]'))
    return read(spark, sf_dir, "customer").where(k % 7 != 0).select(k.alias("recording_id"), F.when(k % 11 == 0, F.concat(F.lit("["), whole)).otherwise(whole).alias("json"))


SEGMENTS = f"""r AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0),
  s AS (SELECT k, 0.0::DOUBLE AS start, {_LENGTH} AS "end", 'said ' || k AS text, CASE k % 3 WHEN 0 THEN k WHEN 2 THEN k * 10 END AS speaker_id FROM r
    UNION ALL SELECT k, 1.5, 2 + (k % 5) * 0.125, CASE WHEN k % 4 = 0 THEN '' ELSE 'more' END, k * 10 FROM r),
  segments AS (SELECT k AS recording_id, k || '_audio.wav' AS audio_path, start, "end", "end" - start AS duration, text, speaker_id FROM s WHERE text <> '' AND "end" - start BETWEEN 0.5 AND 30)"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = read(spark, sf_dir, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("recording_id"))
    return manifest.build_manifest(manifest.with_paths(recordings(spark, sf_dir)), transcripts(spark, sf_dir), heard)


@query(f"WITH {SEGMENTS} SELECT * FROM segments")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of recordings that have audio and a transcript that can be read."""
    return _manifest(spark, sf_dir)


@query(f"WITH {SEGMENTS} SELECT count(*) AS segments, count(DISTINCT recording_id) AS recordings, round(sum(duration) / 3600, 9) AS hours FROM segments")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_summary(_manifest(spark, sf_dir)).withColumn("hours", F.round("hours", 9))


@query("SELECT c_custkey * 10 AS user_id, c_custkey AS recording_id, 'http://new/x/' || c_custkey AS rec_url, c_custkey || '_audio.wav' AS audio_path, c_custkey || '_transcription.json' AS transcript_path FROM customer")
def csv_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written as CSV and read again, addresses replaced, paths added."""
    path = scratch(spark, "recordings")
    tables.write_csv(recordings(spark, sf_dir).select("user_id", "recording_id", F.lit("hi").alias("language"), F.lit(1.5).alias("duration"), "rec_url", F.lit("").alias("transcription_url"), F.lit("").alias("metadata_url")), path)
    back = manifest.rewrite_urls(tables.read_recordings(spark, path), "/old/", "/new/")
    return manifest.with_paths(back).select("user_id", "recording_id", "rec_url", "audio_path", "transcript_path")


@query("SELECT s_suppkey AS recording_id, '[{\"start\":0,\"end\":1,\"text\":\"' || s_name || '\"}]' AS json FROM supplier WHERE s_suppkey <= 20")
def json_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as files of their own, read again by the number in their names; a file for each of a few suppliers."""
    path = scratch(spark, "transcripts")
    rows = read(spark, sf_dir, "supplier").where("s_suppkey <= 20").select("s_suppkey", F.concat(F.lit('[{"start":0,"end":1,"text":"'), F.col("s_name"), F.lit('"}]')).alias("json"))
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for r in rows.collect():
        at = fs.Path(f"{path}/{r.s_suppkey}_transcription.json")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(r.json.encode()))
        out.close()
    return tables.read_transcripts(spark, path)


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def table_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table built and written the first time and read the second."""
    path = scratch(spark, "cache")
    build = lambda: read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    tables.cached(spark, path, build)
    return tables.cached(spark, path, lambda: spark.range(0).select(F.col("id").alias("c_nationkey"), F.col("id").alias("n")))


@query("SELECT count(*) AS files, count(*) FILTER (WHERE length(url) % 3 <> 0 AND length(url) % 5 <> 0) AS fetched FROM pages")
def fetch_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches counted by success, with a fetch that fails for some addresses and raises for others."""

    def fetch(url: str, dest: str) -> bool:
        if len(url) % 5 == 0:
            raise OSError(dest)
        return len(url) % 3 != 0

    got = tables.fetch_all(read(spark, sf_dir, "pages").select("url", F.col("page_id").cast("string").alias("dest")), "url", "dest", fetch)
    return got.agg(F.count("*").alias("files"), F.sum(F.col("ok").cast("long")).alias("fetched"))


def tone(seconds: float, level: int, rate: int = 8000) -> bytes:
    """A WAV file of one constant sample, in two channels."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.full(int(seconds * rate) * 2, level, "<i2").tobytes())
    return out.getvalue()


def recorded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments and WAV files of suppliers: a file's length and level are set by its key, a segment starts at 0.25 s; some files are junk."""

    @F.pandas_udf("binary")
    def content(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in keys:
            for i in range(0, len(s), 50):  # files are far larger than their keys
                yield pd.Series([b"junk" if k % 17 == 0 else tone(k % 9 * 0.25 + 0.25, k % 100 * 300) for k in s.iloc[i : i + 50]])

    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier")
    path = F.concat(k.cast("string"), F.lit("_audio.wav"))
    segments = rows.select(k.alias("recording_id"), path.alias("audio_path"), F.lit(0.25).alias("start"), (k % 8 * 0.25 + 0.25).alias("end"), F.when(k % 10 == 0, "?!").otherwise(F.concat(F.lit("घर-"), k.cast("string"))).alias("text"))
    return segments, rows.select(path.alias("audio_path"), content(k).alias("content"))


#: Samples are at 16 kHz; a segment ends where its file does.
HEARD = """heard AS (SELECT s_suppkey AS k, least(s_suppkey % 8 * 0.25 + 0.25, s_suppkey % 9 * 0.25 + 0.25) - 0.25 AS duration, s_suppkey % 100 * 300 / 32768 AS level FROM supplier WHERE s_suppkey % 17 <> 0 AND s_suppkey % 10 <> 0),
  kept AS (SELECT * FROM heard WHERE duration >= 0.5)"""


@query(f"WITH {HEARD} SELECT k AS recording_id, 'घर ' || k AS text, round(duration, 6) AS duration, (duration * 16000)::INT AS samples, 16000 AS sampling_rate, round(level, 4) AS level FROM kept")
def audio_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut from audio, mixed to one channel at 16 kHz, long enough and with text."""
    data = audio.build_dataset(*recorded(spark, sf_dir))
    level = F.aggregate("audio.array", F.lit(0.0), lambda a, x: a + x) / F.size("audio.array")
    return data.select("recording_id", "text", F.round("duration", 6).alias("duration"), F.size("audio.array").alias("samples"), "audio.sampling_rate", F.round(level, 4).alias("level"))


@query(f"WITH {HEARD} SELECT k AS index, 'heard ' || (duration * 16000)::INT AS text FROM kept")
def model_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a model that the caller gives: here one that says how many samples it got."""
    data = audio.build_dataset(*recorded(spark, sf_dir)).withColumnRenamed("recording_id", "index")
    return audio.run_inference(data, lambda: lambda batch: [f" heard {len(x)} " for x in batch])


@query(f"WITH {HEARD} SELECT (duration * 16000)::INT // 4000 AS frames, round(level, 4) AS level, length('घर ' || k) AS labels, count(*) AS n FROM kept GROUP BY ALL")
def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and labels by an extractor and a tokenizer that the caller gives."""
    data = audio.build_dataset(*recorded(spark, sf_dir))
    got = audio.features(data, lambda x: x[: len(x) // 4000 * 4000].reshape(-1, 4000)[:, :3], lambda t: [ord(c) for c in t])
    return got.select(F.size("input_features").alias("frames"), F.round(F.get("input_features", F.lit(0))[0].cast("double"), 4).alias("level"), F.size("labels").cast("long").alias("labels")).groupBy("frames", "level", "labels").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT p_partkey, p_partkey // 4 AS batch, list_transform(range(0, p_size % 5 + 1), lambda i: (p_size + i) || '/' || i) AS x FROM part), m AS (SELECT *, max(len(x)) OVER (PARTITION BY batch) AS n FROM f)
SELECT p_partkey, batch, array_to_string(list_concat(x, list_transform(range(0, n - len(x)), lambda i: '0/0')), ' ') AS frames FROM m""")
def feature_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames padded with zeros to the longest of a batch."""
    frames = F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), lambda i: F.array((F.col("p_size") + i).cast("float"), i.cast("float")))
    out = manifest.collate_features(read(spark, sf_dir, "part").select("p_partkey", frames.alias("input_features")), "p_partkey")
    shown = F.transform("input_features", lambda x: F.concat_ws("/", x[0].cast("int").cast("string"), x[1].cast("int").cast("string")))
    return out.select("p_partkey", "batch", F.array_join(shown, " ").alias("frames"))


@query(f"WITH {SEGMENTS} SELECT count(*) AS n_segments, count(DISTINCT recording_id) AS n_recordings, count(DISTINCT speaker_id) AS n_speakers, median(duration) AS median FROM segments")
def segments_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest and statistics end to end, over the recordings that have audio."""
    heard = recordings(spark, sf_dir).where("recording_id % 13 <> 0")
    _, stats = pipelines.segments(heard, transcripts(spark, sf_dir))
    return stats.select("n_segments", "n_recordings", "n_speakers", "median")
