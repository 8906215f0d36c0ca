"""Transcription lattices by consensus of several models, and the evaluation that uses them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import LATTICE_NUMBERS, LATTICE_SPELLINGS
from ..functions.text import align_tokens, fixed, missing, strip_ws
from ..functions.wer import bind, lattice_wer, standard_wer
from .alignment import align


def long_form(wide: DataFrame, reference: str = "Human") -> DataFrame:
    """(segment, model, ref, hyp) with words as arrays, from a table whose first column names the segment and whose other columns are models.

    Rows without a reference, and cells without a transcript, fall out: null, blank, or the text nan. Names of models are read off the table's schema.
    """
    segment, models = wide.columns[0], [c for c in wide.columns[1:] if c != reference and c.strip()]
    rows = wide.where(~missing(F.col(reference))).select(F.col(segment).cast("string").alias("segment"), F.col(reference).alias("_ref"), *[F.col(f"`{m}`").cast("string").alias(m) for m in models])
    long = rows.unpivot(["segment", "_ref"], models, "model", "_hyp").where(~missing(F.col("_hyp")))
    return long.select("segment", "model", align_tokens(strip_ws("_ref")).alias("ref"), align_tokens(strip_ws("_hyp")).alias("hyp"))


def consensus_votes(aligned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(segment, pos, word, votes) for words that enough models put at a place of the reference.

    aligned: (segment, model, hyp, ops). Matches and substitutions vote, insertions don't; a word needs max(1, ceil(threshold * models)) votes,
    models being those with a transcript of the segment.
    """
    models = aligned.groupBy("segment").agg(F.count_distinct("model").alias("models"))
    votes = aligned.select("segment", "hyp", F.explode("ops").alias("o")).where(F.col("o.op").isin("M", "S"))
    votes = votes.groupBy("segment", F.col("o.ref_pos").alias("pos"), F.get("hyp", F.col("o.hyp_pos")).alias("word")).agg(F.count("*").alias("votes"))
    return votes.join(models.hint("merge"), "segment").where(F.col("votes") >= F.greatest(F.lit(1), F.ceil(F.col("models") * threshold))).select("segment", "pos", "word", "votes")


def _more(word: Column, table: dict[str, list[str]]) -> Column:
    if not table:
        return F.array().cast("array<string>")
    entries = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(list(v)))])
    return F.coalesce(F.element_at(entries, word), F.array().cast("array<string>"))


def expand_bin(words: Column, synonyms: dict[str, list[str]] | None = None, numbers: bool = True) -> Column:
    """A bin with what stands for its words: digits and number words, then synonyms, then other spellings, one hop each and in this order; sorted."""
    to_digit = {w: [d] for d, ws in LATTICE_NUMBERS.items() for w in ws}
    steps = ([LATTICE_NUMBERS | to_digit] if numbers else []) + ([{k: list(v) for k, v in synonyms.items()}] if synonyms else []) + [LATTICE_SPELLINGS]
    for table in steps:
        words = F.array_union(words, F.flatten(F.transform(words, lambda w: _more(w, table))))  # noqa: B023
    return F.array_sort(words)


def build_lattice(outputs: DataFrame, threshold: float = 0.5, expand: bool = True, synonyms: dict[str, list[str]] | None = None, numbers: bool = True) -> DataFrame:
    """(segment, bins) from (segment, model, ref, hyp): a bin of accepted words for each word of the reference, the reference's own always among them.

    A segment's reference must be the same in all its rows. Everything is grouped by segment, so no group is larger than an utterance.
    """
    # A segment's rows meet once, in one grouping, and nothing is joined: the rest happens within a row, whose size is an utterance's.
    voted = outputs.select("segment", "model", "ref", "hyp", align("ref", "hyp").alias("ops"))
    vote = F.transform(F.filter("ops", lambda o: o.op.isin("M", "S")), lambda o: F.struct(o.ref_pos.alias("pos"), F.get("hyp", o.hyp_pos).alias("word")))
    grouped = voted.select("segment", "model", "ref", vote.alias("v")).groupBy("segment").agg(F.min("ref").alias("ref"), F.size(F.collect_set("model")).alias("models"), F.flatten(F.collect_list("v")).alias("v"))
    least = F.greatest(F.lit(1), F.ceil(F.col("models") * threshold))
    here = lambda i: F.transform(F.filter("v", lambda v: v["pos"] == i), lambda v: v["word"])
    agreed = lambda words: F.filter(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda x: x == w)) >= F.col("least"))
    bins = F.transform("ref", lambda w, i: bind(here(i), lambda words: F.array_sort(F.array_union(F.array(w), agreed(words)))))
    out = grouped.withColumn("least", least).select("segment", bins.alias("bins"))
    return out.withColumn("bins", F.transform("bins", lambda b: expand_bin(b, synonyms, numbers))) if expand else out


def score_models(outputs: DataFrame, lattice: DataFrame) -> DataFrame:
    """(segment, model, standard_wer, lattice_wer) of each output."""
    rows = outputs.join(lattice.hint("merge"), "segment")  # as large as the outputs, whatever its estimate: never broadcast
    return rows.select("segment", "model", standard_wer(F.col("ref"), F.col("hyp")).alias("standard_wer"), lattice_wer(F.col("bins"), F.col("hyp")).alias("lattice_wer"))


def summarize_models(scores: DataFrame, skip_infinite: bool = False) -> DataFrame:
    """Means over utterances for each model. An utterance without reference words has an infinite rate, and so has its model, unless skip_infinite is set."""
    if skip_infinite:
        scores = scores.where(F.col("standard_wer") != float("inf"))
    means = scores.groupBy("model").agg(F.avg("standard_wer").alias("standard_wer"), F.avg("lattice_wer").alias("lattice_wer"), F.count("*").alias("utterances"))
    delta = F.col("standard_wer") - F.col("lattice_wer")
    return means.withColumn("reduction", delta).withColumn("status", F.when(delta > 0.001, "✓ Reduced").otherwise("— Unchanged"))


def summary_table(summary: DataFrame) -> DataFrame:
    """The summary as it is printed, rates as text with four places."""
    return summary.orderBy("model").select(
        F.col("model").alias("Model"), fixed(F.col("standard_wer"), 4).alias("Standard WER"), fixed(F.col("lattice_wer"), 4).alias("Lattice WER"),
        fixed(F.col("reduction"), 4).alias("WER Reduction"), F.col("status").alias("Fairly Penalized?"),
    )


def evaluate_models(wide: DataFrame, reference: str = "Human", synonyms: dict[str, list[str]] | None = None, numbers: bool = True) -> DataFrame:
    """From a wide table of transcripts to the summary of its models; models without a transcript are left out."""
    outputs = long_form(wide, reference)
    return summarize_models(score_models(outputs, build_lattice(outputs, 0.5, True, synonyms, numbers)))


def demo_lattice(spark, reference: str, outputs: dict[str, str]) -> DataFrame:
    """One utterance as a wide table."""
    return reduce(lambda df, kv: df.withColumn(kv[0], F.lit(kv[1])), outputs.items(), spark.createDataFrame([("1", reference)], "segment string, Human string"))
