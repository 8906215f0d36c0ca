"""Error sampling and the taxonomy of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.errors import classify_error, reason_for

SAMPLES, WORST = 25, 100

#: What could be done about the most frequent categories, in our words.
FIXES = [
    ("Number Format Mismatch", "Number normalisation", "Write numbers of both sides in one format before scoring.", "high"),
    ("English Loan Word Error", "Script normalisation", "Accept an English word in either script.", "medium"),
    ("Homophone Substitution", "Rescoring", "Choose among the best hypotheses with a language model.", "medium"),
]


def worst_errors(predictions: DataFrame, n: int = WORST, wer: str = "finetuned_wer", key: str = "index") -> DataFrame:
    """The n rows of the largest positive error rate, ties by key, with their rank from 1. Only these n rows are ever ranked together."""
    top = predictions.where((F.col(wer) > 0) & ~F.isnan(wer)).orderBy(F.desc(wer), key).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(wer), key)))


def sample_errors(predictions: DataFrame, n_samples: int = SAMPLES, worst: int = WORST, wer: str = "finetuned_wer", key: str = "index") -> DataFrame:
    """Systematic sample of the worst rows: every step-th from the first, step being max(1, rows div n_samples), n_samples at most; with sample_rank from 0."""
    top = worst_errors(predictions, worst, wer, key)
    step = F.greatest(F.lit(1), F.floor(F.max("rank").over(W.partitionBy(F.lit(0))) / n_samples))
    picked = top.withColumn("_step", step).where(((F.col("rank") - 1) % F.col("_step") == 0) & ((F.col("rank") - 1) / F.col("_step") < n_samples))
    return picked.withColumn("sample_rank", ((F.col("rank") - 1) / F.col("_step")).cast("int")).drop("_step")


def label_errors(sample: DataFrame, pred: str = "finetuned_prediction", wer: str = "finetuned_wer", order: str = "sample_rank") -> DataFrame:
    """(category, order, reference, prediction, wer): a row for each category that an error has."""
    return sample.select(F.explode(classify_error(F.col("reference"), F.col(pred))).alias("category"), F.col(order).alias("order"), "reference", F.col(pred).alias("prediction"), F.col(wer).alias("wer"))


def category_counts(labelled: DataFrame) -> DataFrame:
    """(category, n, first_order), most frequent first; ties by where a category first shows."""
    return labelled.groupBy("category").agg(F.count("*").alias("n"), F.min("order").alias("first_order")).orderBy(F.desc("n"), "first_order")


def taxonomy(labelled: DataFrame, examples: int = 5) -> DataFrame:
    """(category, n, examples) with the first few errors of each category and the category's reason; n counts all of them."""
    first = labelled.withColumn("_rn", F.row_number().over(W.partitionBy("category").orderBy("order", "reference", "prediction"))).where(F.col("_rn") <= examples)
    first = first.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("_rn", "reference", "prediction", "wer", reason_for(F.col("category")).alias("reasoning")))).alias("e"))
    shown = F.transform("e", lambda x: F.struct(x.reference.alias("reference"), x.prediction.alias("prediction"), x.wer.alias("wer"), x.reasoning.alias("reasoning")))
    return category_counts(labelled).join(first, "category").select("category", "n", "first_order", shown.alias("examples")).orderBy(F.desc("n"), "first_order").drop("first_order")


def fix_proposals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXES, "category string, proposal string, description string, feasibility string")
