"""From recordings and transcripts to a manifest of utterances, its statistics, splits and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rewrite_url, strip_ws

TRANSCRIPT = "array<struct<start:double,end:double,speaker_id:bigint,text:string>>"
SHORTEST, LONGEST = 0.5, 30.0


def rewrite_urls(df: DataFrame, old: str, new: str) -> DataFrame:
    """Every column whose name contains url, in any case, with one address part replaced; both parts are parameters."""
    return df.withColumns({c: rewrite_url(F.col(f"`{c}`"), old, new) for c in df.columns if "url" in c.lower()})


def with_paths(recordings: DataFrame, folder: str = "") -> DataFrame:
    base = F.concat(F.lit(folder), F.col("recording_id").cast("string"))
    return recordings.withColumns({"audio_path": F.concat(base, F.lit("_audio.wav")), "transcript_path": F.concat(base, F.lit("_transcription.json"))})


def parse_transcript(text: Column) -> Column:
    """Segments of a transcript's JSON; broken or missing JSON gives none."""
    return F.coalesce(F.from_json(text, TRANSCRIPT), F.array().cast(TRANSCRIPT))


def _spoken(json: Column) -> Column:
    """Segments with `named`, whether they have a speaker at all: an explicit null is a speaker that isn't known."""
    keys = F.coalesce(F.from_json(json, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    return F.zip_with(parse_transcript(json), keys, lambda s, k: F.struct(s.start.alias("start"), s.end.alias("end"), s.speaker_id.alias("speaker_id"), s.text.alias("text"), F.coalesce(F.map_contains_key(k, "speaker_id"), F.lit(False)).alias("named")))


def build_manifest(recordings: DataFrame, transcripts: DataFrame, audio: DataFrame | None = None, shortest: float = SHORTEST, longest: float = LONGEST) -> DataFrame:
    """One row an utterance: recording_id, audio_path, start, end, duration, text, speaker_id.

    recordings: (recording_id, user_id, audio_path); transcripts: (recording_id, json); audio: (recording_id) of the files there are, all if None.
    Kept are utterances with text and a duration from shortest to longest, both included. Where a segment names no speaker, its
    recording's user speaks; a speaker that is null stays null. Joins are by recording, never by position; recordings without transcript fall out, and no rows is a valid result.
    """
    rows = recordings.join(transcripts.select("recording_id", "json"), "recording_id")
    if audio is not None:
        rows = rows.join(audio.select("recording_id"), "recording_id", "left_semi")
    segments = rows.select("recording_id", "audio_path", "user_id", F.explode(_spoken(F.col("json"))).alias("s"))
    out = segments.select(
        F.col("recording_id").cast("long").alias("recording_id"), "audio_path", F.col("s.start").alias("start"), F.col("s.end").alias("end"), (F.col("s.end") - F.col("s.start")).alias("duration"),
        strip_ws(F.col("s.text")).alias("text"), F.when(F.col("s.named"), F.col("s.speaker_id")).otherwise(F.col("user_id").cast("long")).alias("speaker_id"),
    )
    return out.where((F.col("text") != "") & F.col("duration").between(shortest, longest))


def metadata_summary(recordings: DataFrame) -> DataFrame:
    return recordings.agg(F.count("*").alias("recordings"), F.count_distinct("user_id").alias("users"), (F.sum("duration") / 3600).alias("hours"))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("segments"), F.count_distinct("recording_id").alias("recordings"), (F.sum("duration") / 3600).alias("hours"))


def exact_quantiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with the exact quantiles (linear between neighbours) of a column, nulls left out, null where there are no values.

    Values are counted one by one, then by buckets, 64 for each doubling, whose running counts show which buckets the quantiles lie in; buckets
    number some 140,000 at most. Only the distinct values of those few buckets are put in order, each bucket by one task, which spills if need be.
    """
    v = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    bits = F.round(F.log2(1 + F.abs("v")) * 64).cast("long") * F.signum("v").cast("long")
    v = v.withColumn("b", bits)
    sums = v.groupBy("b").agg(F.sum("n").alias("m"))
    before = sums.select("b", (F.sum("m").over(W.orderBy("b")) - F.col("m")).alias("before"), "m", F.sum("m").over(W.partitionBy(F.lit(0))).alias("total"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in shares.items()]))
    at = before.select("*", asked.alias("q")).select("b", "before", "m", "q.name", (F.col("q.p") * (F.col("total") - 1)).alias("at"))
    hit = at.where((F.floor("at") < F.col("before") + F.col("m")) & (F.ceil("at") >= F.col("before")))
    near = v.join(F.broadcast(hit), "b")
    upto = F.sum("n").over(W.partitionBy("name", "b").orderBy("v")) + F.col("before")
    near = near.select("name", "at", "v", upto.alias("upto"), (upto - F.col("n")).alias("from"))
    value_at = lambda place: F.max(F.when((F.col("from") <= place) & (place < F.col("upto")), F.col("v")))
    ends = near.groupBy("name", "at").agg(value_at(F.floor("at")).alias("lo"), value_at(F.ceil("at")).alias("hi"))
    ends = ends.select("name", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("v"))
    return ends.agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])


def corpus_stats(manifest: DataFrame, duration: str = "duration", recording: str = "recording_id", speaker: str = "speaker_id") -> DataFrame:
    """Nine figures of a manifest; the median is exact."""
    d = F.col(duration)
    rest = manifest.agg(
        F.count("*").alias("n_segments"), (F.sum(d) / 3600).alias("hours"), F.count_distinct(recording).alias("n_recordings"), F.count_distinct(speaker).alias("n_speakers"),
        F.avg(d).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max"), F.stddev_samp(d).alias("std"),
    )
    both = rest.crossJoin(F.broadcast(exact_quantiles(manifest, duration, {"median": 0.5})))  # one row each
    return both.select("n_segments", "hours", "n_recordings", "n_speakers", "mean", "median", "min", "max", "std")


def describe_duration(manifest: DataFrame, duration: str = "duration") -> DataFrame:
    """count, mean, std, min, exact quartiles, max."""
    d = F.col(duration)
    rest = manifest.agg(F.count(d).alias("count"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"))
    both = rest.crossJoin(F.broadcast(exact_quantiles(manifest, duration, {"q25": 0.25, "q50": 0.5, "q75": 0.75})))  # one row each
    return both.select("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def exact_split(rows: DataFrame, key: str, percent: int = 10, seed: int = 42, buckets: int = 65_536) -> DataFrame:
    """rows with `split`: exactly ceil(rows * percent / 100) of them 'eval', the others 'train', in an order that seed and key alone decide.

    Rows are counted by the leading digits of their order key; those counts show in which bucket the split falls, and just that
    bucket's rows, a share of 1 / buckets, are put in order, others are told by their bucket alone. Give as many buckets as leave
    one some thousand rows: default 65,536, and more for tables beyond 10^9 rows. Keys should be distinct; rows that share one are interchangeable.
    """
    digits = 1
    while 16**digits < buckets:
        digits += 1
    keyed = rows.withColumn("_k", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))).withColumn("_b", F.substring("_k", 1, digits))
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    one = W.partitionBy(F.lit(0))
    edge = counts.select("_b", (F.sum("_n").over(one.orderBy("_b")) - F.col("_n")).alias("_before"), F.ceil(F.sum("_n").over(one) * percent / 100).alias("_want"))
    # The bucket in which the split falls, and how many of its rows are on the near side: one row, none for an empty table.
    edge = edge.where("_before < _want").orderBy(F.desc("_b")).limit(1).select(F.col("_b").alias("_at"), (F.col("_want") - F.col("_before")).alias("_left"))
    dealt = keyed.crossJoin(F.broadcast(edge))
    rest = dealt.where("_b <> _at").withColumn("split", F.when(F.col("_b") < F.col("_at"), "eval").otherwise("train"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_k", key))
    torn = dealt.where("_b = _at").withColumn("split", F.when(rank <= F.col("_left"), "eval").otherwise("train"))
    return rest.select(*rows.columns, "split").unionByName(torn.select(*rows.columns, "split"))


def collate_features(rows: DataFrame, key: str = "index", features: str = "input_features", size: int = 4) -> DataFrame:
    """rows with batch (by ranges of key from 0) and features, arrays of frames, padded with frames of zeros to their batch's longest."""
    rows = rows.withColumn("batch", F.floor(F.col(key) / size).cast("long")).withColumn("_n", F.max(F.size(features)).over(W.partitionBy("batch")))
    blank = F.transform(F.coalesce(F.get(features, F.lit(0)), F.array().cast("array<float>")), lambda x: x * 0)
    return rows.withColumn(features, F.concat(F.col(features), F.array_repeat(blank, F.col("_n") - F.size(features)))).drop("_n")


def collate_labels(rows: DataFrame, key: str = "index", labels: str = "labels", size: int = 4, bos: int | None = None, mask: int = -100) -> DataFrame:
    """rows with batch (by ranges of key from 0) and labels padded with mask to their batch's longest; a first token bos goes if all of a batch have it."""
    rows = rows.withColumn("batch", F.floor(F.col(key) / size).cast("long"))
    batch = W.partitionBy("batch")
    longest = F.max(F.size(labels)).over(batch)
    padded = rows.withColumn("_all", F.min((F.get(labels, F.lit(0)) == bos).cast("int")).over(batch) == 1 if bos is not None else F.lit(False)).withColumn("_n", longest)
    full = F.concat(F.col(labels), F.array_repeat(F.lit(mask), F.col("_n") - F.size(labels)))
    return padded.withColumn(labels, F.when(F.col("_all"), F.slice(full, F.lit(2), F.greatest(F.col("_n") - 1, F.lit(0)))).otherwise(full)).drop("_all", "_n")
