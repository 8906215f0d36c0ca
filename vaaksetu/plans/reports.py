"""Markdown of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import shorten
from ..operators import evaluation, lattice, spelling, taxonomy


def table(df: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of at most `limit` rows."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def _once(small: DataFrame) -> DataFrame:
    """The same rows, worked out now; for results that are small by definition."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def wer(predictions: DataFrame, seconds: dict[str, float] | None = None) -> str:
    n = predictions.count()
    return f"# Word error rates\n\n{table(evaluation.wer_report(predictions, seconds=seconds).drop('wer', 'seconds'))}\n\nUtterances: {n}\n"


def errors(predictions: DataFrame, examples: int = 3) -> str:
    """Categories with their true counts and first examples, then the effect of the number fix, texts shortened to 40 and 30 characters."""
    # The sampled errors and the rows of fixes are some ten rows each: they are worked out once, then every table is made of them.
    labelled = _once(taxonomy.label_errors(taxonomy.sample_errors(predictions)))
    out = ["# Errors", ""]
    for r in taxonomy.taxonomy(labelled, examples).collect():
        out += [f"## {r.category} ({r.n})", ""]
        for e in r.examples:
            out += [f"- reference: {e.reference}", f"  prediction: {e.prediction}", f"  WER {e.wer:.3f}: {e.reasoning}"]
        out.append("")
    fixes = _once(evaluation.fix_results(predictions))
    shown = evaluation.fix_table(fixes).select(shorten(F.col("reference"), 40).alias("reference"), *[shorten(F.col(f"prediction_{w}"), 30).alias(w) for w in ("before", "after")], "wer_before", "wer_after", "improved")
    out += ["## Proposals", "", table(taxonomy.fix_proposals(predictions.sparkSession)), "", "## Effect of number normalisation", "", table(shown), "", table(evaluation.fix_means(fixes))]
    return "\n".join(out) + "\n"


def spellings(classified: DataFrame, review: int = 20) -> str:
    low = spelling.review_low_confidence(classified)
    parts = [spelling.counts_by(classified, "spelling").orderBy("spelling"), spelling.confidence_counts(classified), low.limit(review), spelling.unreliable_categories(classified.sparkSession)]
    names = ["Words", "Confidence", "Low confidence", "Where it can't be relied on"]
    return "# Spelling\n\n" + "\n".join(f"## {n}\n\n{table(p)}\n" for n, p in zip(names, parts))


def lattices(summary: DataFrame) -> str:
    return f"# Lattice evaluation\n\nA bin holds the reference's word, words that at least half of the models agree on, and what stands for either.\n\n{table(lattice.summary_table(summary))}\n"
