"""The four analyses end to end."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CORE_VOCABULARY
from ..functions.loanwords import tag_loans
from ..functions.numbers import normalize_numbers
from ..functions.text import clean_text
from ..operators import evaluation, lattice, manifest, spelling, taxonomy


def recognition_errors(references: DataFrame, pretrained: DataFrame, finetuned: DataFrame) -> dict[str, DataFrame]:
    """From references and two models' predictions (index, text) to rates, sampled errors, their taxonomy and the effect of a fix."""
    predictions = evaluation.predictions_table(references, pretrained, finetuned)
    labelled = taxonomy.label_errors(taxonomy.sample_errors(predictions))
    fixes = evaluation.fix_results(predictions)
    return {"predictions": predictions, "report": evaluation.wer_report(predictions), "taxonomy": taxonomy.taxonomy(labelled), "fixes": fixes, "fix_means": evaluation.fix_means(fixes)}


def segments(recordings: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest of utterances and its statistics."""
    rows = manifest.build_manifest(manifest.with_paths(recordings), transcripts)
    return rows, manifest.corpus_stats(rows)


def cleanup(text: Column) -> Column:
    """Numbers as digits, then loan words tagged."""
    return tag_loans(normalize_numbers(text))


def cleanup_impact(pairs: DataFrame) -> DataFrame:
    """What each step of the clean-up does to the error rate of predictions."""
    pred = F.col("prediction")
    return evaluation.cleanup_impact(pairs, {"raw": pred, "clean": clean_text(pred), "numbers": normalize_numbers(pred), "tags": tag_loans(pred), "both": cleanup(pred)})


def spell_check(words: DataFrame, vocabulary: Iterable[str] = CORE_VOCABULARY) -> dict[str, DataFrame]:
    rows = spelling.classify_list(words, vocabulary)
    return {"words": rows, "classes": spelling.counts_by(rows, "spelling"), "confidence": spelling.confidence_counts(rows), "review": spelling.review_low_confidence(rows)}


def lattice_evaluation(wide: DataFrame) -> DataFrame:
    return lattice.evaluate_models(wide)
