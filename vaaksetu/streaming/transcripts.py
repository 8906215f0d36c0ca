"""Transcript functions on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.wer import word_edits
from ..functions.text import tokens


def annotate(stream: DataFrame, **columns: Column) -> DataFrame:
    """A stream with more columns. All functions of this package are stateless expressions, so they hold on streams as on tables."""
    return stream.withColumns(columns)


def rolling_wer(stream: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes", ref: str = "reference", pred: str = "prediction") -> DataFrame:
    """Micro WER for each window of event time; rows later than `late` are dropped and a window's state with them."""
    a, b = tokens(F.col(ref)), tokens(F.col(pred))
    sums = stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.sum(word_edits(a, b)).alias("edits"), F.sum(F.size(a).cast("long")).alias("words"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "edits", "words", (F.col("edits") / F.col("words")).alias("wer"))


def for_each_batch(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Runs a table operator, such as a lattice evaluation, on each micro-batch and writes its result under the batch's number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
