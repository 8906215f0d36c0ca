"""Audio segments from WAV files, and what is built from them."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .tables import bound_batches

RATE = 16_000


def read_range(source: bytes | str, start: float, end: float, rate: int = RATE) -> np.ndarray | None:
    """Samples of one channel, the mean of all, from `start` to `end` seconds; resampled linearly if the file has another rate. None if it can't be read.

    source: a file's bytes, or its path or address, of which only the header and the range are read.
    """
    try:
        with opened(source) as data, wave.open(data) as w:
            own, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
            first = int(start * own)
            w.setpos(first)
            raw = w.readframes(max(0, int(end * own) - first))
        kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[width]
        x = np.frombuffer(raw, kind).astype(np.float64)
        x = (x - 128) / 128 if width == 1 else x / float(1 << 8 * width - 1)
        x = x.reshape(-1, channels).mean(axis=1)
    except (wave.Error, EOFError, KeyError, ValueError, OSError):
        return None
    if own != rate and len(x):
        n = int(len(x) * rate / own)
        x = np.interp(np.arange(n) * own / rate, np.arange(len(x)), x)
    return x.astype(np.float32)


def opened(source: bytes | str):
    if isinstance(source, str):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(source) if "://" in source else (fs.LocalFileSystem(), source)
        return where.open_input_file(path)
    return io.BytesIO(source)


def read_audio(spark, folder: str) -> DataFrame:
    """(path, content) of the WAV files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path", "content")


def build_dataset(manifest: DataFrame, files: DataFrame | None = None, rate: int = RATE, shortest: float = 0.5, longest: float = 30.0) -> DataFrame:
    """audio struct<array,sampling_rate>, text, recording_id, duration; from a manifest.

    Segments that can't be read, are too short or too long, or have no text once cleaned, fall out. Without `files` each segment's range
    is read from its audio_path, a path or address that all tasks can open: no file is read or moved whole. `files`, (audio_path, content), is for
    short files that are a table already; their bytes travel to each of their segments.
    """

    @F.pandas_udf("array<float>")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for content, start, end in batches:
            for i in range(0, len(content), 50):  # of paths, a batch has many
                yield pd.Series([read_range(c, s, e, rate) for c, s, e in zip(content.iloc[i : i + 50], start.iloc[i : i + 50], end.iloc[i : i + 50])], dtype=object)

    # Contents are large, however small the table's estimate is: never through the driver, and few of them in a batch.
    bound_batches(manifest.sparkSession)
    rows = manifest.withColumn("content", F.col("audio_path")) if files is None else manifest.join(files.hint("merge"), "audio_path")
    rows = rows.select(cut("content", "start", "end").alias("samples"), clean_text(F.col("text")).alias("text"), "recording_id")
    n = F.size("samples")
    kept = rows.where(F.col("samples").isNotNull() & (n >= shortest * rate) & (n <= longest * rate) & (F.col("text") != ""))
    return kept.select(F.struct(F.col("samples").alias("array"), F.lit(rate).alias("sampling_rate")).alias("audio"), "text", F.col("recording_id").cast("long").alias("recording_id"), (F.size("samples") / rate).alias("duration"))


def run_inference(dataset: DataFrame, load_model: Callable[[], Callable[[list[np.ndarray]], list[str]]], key: str = "index", batch: int = 8) -> DataFrame:
    """(key, text): predictions of any model. load_model runs once a task and returns a function from a batch of sample arrays to texts, which are stripped."""

    @F.pandas_udf("string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for samples in batches:
            out: list[str] = []
            for i in range(0, len(samples), batch):
                out += model([np.asarray(x, np.float32) for x in samples.iloc[i : i + batch]])
            yield pd.Series([t.strip() for t in out])

    return dataset.select(key, predict("audio.array").alias("text"))


def features(dataset: DataFrame, extract: Callable[[np.ndarray], np.ndarray], tokenize: Callable[[str], list[int]]) -> DataFrame:
    """input_features array<array<float>> and labels array<int>, by the caller's feature extractor and tokenizer."""

    @F.pandas_udf("array<array<float>>")
    def mel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for samples in batches:
            for i in range(0, len(samples), 16):  # features may be larger than samples
                yield samples.iloc[i : i + 16].map(lambda x: [list(map(float, r)) for r in extract(np.asarray(x, np.float32))])

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(tokenize(t)))

    return dataset.select(mel("audio.array").alias("input_features"), ids("text").alias("labels"))
