"""Predictions, word error rates and before/after evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import number_mismatch
from ..functions.numbers import normalize_numbers
from ..functions.text import fixed, tokens
from ..functions.wer import sample_wer, word_edits


def corpus_wer(pairs: DataFrame, *by: str, ref: str = "reference", pred: str = "prediction") -> DataFrame:
    """All edits by all reference words, for each group: edits, words, wer. Longer utterances weigh more. Null texts are empty."""
    a, b = (tokens(F.coalesce(F.col(c), F.lit(""))) for c in (ref, pred))
    sums = pairs.groupBy(*by).agg(F.sum(word_edits(a, b)).alias("edits"), F.sum(F.size(a).cast("long")).alias("words"))
    return sums.withColumn("wer", F.when(F.col("words") > 0, F.col("edits") / F.col("words")))


def training_wer(batch: DataFrame, labels: str = "labels", predictions: str = "predictions", pad: int = 0) -> DataFrame:
    """Micro WER in percent of arrays of token ids: -100 in labels stands for padding, and padding is dropped on both sides."""
    bare = lambda c: F.transform(F.filter(F.transform(c, lambda x: F.when(x == -100, pad).otherwise(x)), lambda x: x != pad), lambda x: x.cast("string"))
    a, b = bare(labels), bare(predictions)
    return batch.agg((F.sum(word_edits(a, b)) / F.sum(F.size(a)) * 100).alias("wer"))


def predictions_table(references: DataFrame, pretrained: DataFrame, finetuned: DataFrame) -> DataFrame:
    """One row an utterance with both models' predictions and error rates. All three are (index, text), joined by index, never by position."""
    df = references.select("index", F.col("text").alias("reference")).join(pretrained.select("index", F.col("text").alias("pretrained_prediction")).hint("merge"), "index").join(finetuned.select("index", F.col("text").alias("finetuned_prediction")).hint("merge"), "index")
    for name in ("pretrained", "finetuned"):
        df = df.withColumn(f"{name}_wer", sample_wer(F.col("reference"), F.col(f"{name}_prediction")))
    return df.withColumn("wer_improvement", F.col("pretrained_wer") - F.col("finetuned_wer"))


def wer_report(predictions: DataFrame, names: dict[str, str] | None = None, seconds: dict[str, float] | None = None) -> DataFrame:
    """Model, micro WER with four places and the time taken with one; numbers beside the texts. One pass over the table."""
    names = names or {"pretrained": "Pretrained", "finetuned": "Fine-tuned"}
    ref = tokens(F.col("reference"))
    sums = predictions.agg(*[F.sum(word_edits(ref, tokens(F.col(f"{n}_prediction")))).alias(n) for n in names], F.sum(F.size(ref)).alias("words"))
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(label).alias("Model"), (F.col(n) / F.col("words")).alias("wer"), F.lit((seconds or {}).get(n)).cast("double").alias("seconds")) for n, label in names.items()])).alias("r")).select("r.*")
    return rows.select("Model", fixed(F.col("wer"), 4).alias("Hindi WER"), fixed(F.col("seconds"), 1).alias("Inference Time (s)"), "wer", "seconds")


def fix_results(predictions: DataFrame, limit: int = 10, fix=normalize_numbers) -> DataFrame:
    """Before and after a fix of the prediction, for the first `limit` rows, by index, whose numbers mismatch."""
    rows = predictions.where(number_mismatch(F.col("reference"), F.col("finetuned_prediction"))).orderBy("index").limit(limit)
    after = rows.select("index", "reference", F.col("finetuned_prediction").alias("prediction_before"), fix(F.col("finetuned_prediction")).alias("prediction_after"))
    for when in ("before", "after"):
        after = after.withColumn(f"wer_{when}", sample_wer(F.col("reference"), F.col(f"prediction_{when}")))
    return after.withColumn("improved", F.when(F.col("wer_after") < F.col("wer_before"), "✓").otherwise("✗"))


def fix_table(results: DataFrame) -> DataFrame:
    """fix_results as printed, rates with three places."""
    return results.orderBy("index").select("reference", "prediction_before", "prediction_after", fixed(F.col("wer_before"), 3).alias("wer_before"), fixed(F.col("wer_after"), 3).alias("wer_after"), "improved")


def fix_means(results: DataFrame) -> DataFrame:
    return results.agg(F.avg("wer_before").alias("wer_before"), F.avg("wer_after").alias("wer_after"), F.sum((F.col("improved") == "✓").cast("long")).alias("improved"), F.count("*").alias("rows"))


def cleanup_impact(pairs: DataFrame, steps: dict[str, Column], ref: str = "reference", pred: str = "prediction") -> DataFrame:
    """Micro WER with each way to rewrite the prediction (a Column), all in one pass: step, edits, words, wer."""
    # Steps are columns first: one that runs in Python can't stand within a higher-order function.
    said = pairs.select(F.col(ref).alias("_ref"), *[c.alias(f"s{i}") for i, c in enumerate(steps.values())])
    a = tokens(F.col("_ref"))
    sums = said.agg(*[F.sum(word_edits(a, tokens(F.col(f"s{i}")))).alias(f"e{i}") for i in range(len(steps))], F.sum(F.size(a).cast("long")).alias("words"))
    rows = F.array(*[F.struct(F.lit(name).alias("step"), F.col(f"e{i}").alias("edits")) for i, name in enumerate(steps)])
    return sums.select(F.explode(rows).alias("r"), "words").select("r.*", "words", (F.col("r.edits") / F.col("words")).alias("wer"))
