"""Spelling of word lists, and loan-word density."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import CORE_VOCABULARY
from ..functions.loanwords import is_loan
from ..functions.spelling import classify_word
from ..functions.text import devanagari_only, strip_ws, tokens

LEVELS = ("high", "medium", "low")

#: Kinds of word on which the classification can't be relied, in our words.
UNRELIABLE = [
    ("Proper nouns", "Names of people, places and organisations are in no dictionary and come out as wrong."),
    ("Regional variants", "Dialect forms are right where they are spoken, but differ from the standard vocabulary."),
]


def classify_list(words: DataFrame, vocabulary: Iterable[str] = CORE_VOCABULARY, column: str | None = None) -> DataFrame:
    """(word, spelling, confidence, reason) of the distinct words of a column, the first one by default.

    Words are made distinct before they are classified and as they are written, so two that differ in outer white space both stay. Null and blank words fall out.
    """
    raw = words.select(F.col(column or words.columns[0]).cast("string").alias("raw")).where("raw is not null").groupBy("raw").agg(F.count("*").alias("n"))
    # As the word hangs on a count, no filter on what it is classified as can be moved before the grouping, where it would classify every row.
    rows = raw.select(strip_ws(F.when(F.col("n") > 0, F.col("raw"))).alias("word")).where("word <> ''")
    return rows.withColumn("c", classify_word(F.col("word"), vocabulary)).select("word", "c.spelling", "c.confidence", "c.reason")


def counts_by(classified: DataFrame, column: str) -> DataFrame:
    """(column, n, percent of all rows); the percentage is taken over the counts, not the rows."""
    n = classified.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def confidence_counts(classified: DataFrame) -> DataFrame:
    """(confidence, n) for high, medium and low, zeros included."""
    levels = classified.sparkSession.createDataFrame([(x,) for x in LEVELS], "confidence string")
    return levels.join(classified.groupBy("confidence").agg(F.count("*").alias("n")), "confidence", "left").select("confidence", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def seeded_sample(rows: DataFrame, key: str | Column, n: int, seed: int = 42) -> DataFrame:
    """n rows in an order that seed and key alone decide, the same on any cluster and in any engine with MD5."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), key).limit(n)


def review_low_confidence(classified: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    return seeded_sample(classified.where("confidence = 'low'"), "word", n, seed)


def unreliable_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNRELIABLE, "category string, explanation string")


def loan_density(texts: DataFrame, text: str = "text", order: str = "doc_id", top: int = 20) -> DataFrame:
    """One row: total_words, english_words, english_ratio, and the top loan words by count, ties by where they first show (order, place)."""
    words = texts.select(F.col(order).alias("at"), F.posexplode(tokens(F.col(text))).alias("pos", "token")).select("at", "pos", devanagari_only(F.col("token")).alias("word"), is_loan(F.col("token")).alias("loan"))
    by_word = words.groupBy(F.when(F.col("loan"), F.col("word")).alias("word")).agg(F.count("*").alias("n"), F.min(F.struct("at", "pos")).alias("first"))
    total = by_word.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("english_words"))
    best = by_word.where("word is not null").orderBy(F.desc("n"), "first").limit(top)
    best = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", "word", "n"))).alias("w")).select(F.transform("w", lambda x: F.struct(x.word.alias("word"), x.n.alias("count"))).alias("top_words"), F.lit(0).alias("_j"))
    ratio = F.when(F.col("total_words") > 0, F.col("english_words") / F.col("total_words")).otherwise(0.0)
    return total.withColumn("_j", F.lit(0)).join(best, "_j").select("total_words", "english_words", ratio.alias("english_ratio"), "top_words")
