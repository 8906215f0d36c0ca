"""Layered spelling classification."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CORE_VOCABULARY, PREFIXES, SUFFIXES
from .loanwords import loan_method
from .text import fold_nuqta, strip_ws


def has_known_root(word: Column, vocabulary: list[str]) -> Column:
    """Whether some suffix or prefix leaves a known word, at least two characters being left."""
    size = F.length(word)
    by_suffix = F.exists(F.lit(SUFFIXES), lambda s: F.endswith(word, s) & (size > F.length(s) + 1) & F.substring(word, F.lit(1), size - F.length(s)).isin(vocabulary))
    by_prefix = F.exists(F.lit(PREFIXES), lambda p: F.startswith(word, p) & (size > F.length(p) + 1) & F.substring(word, F.length(p) + 1, size).isin(vocabulary))
    return by_suffix | by_prefix


def well_formed(word: Column) -> Column:
    """Some Devanagari, and no two vowel signs in a row."""
    return F.rlike(word, F.lit(r"[ऀ-ॿ]")) & ~F.rlike(word, F.lit(r"[ा-ौ]{2}"))


def classify_word(word: Column, vocabulary: Iterable[str] = CORE_VOCABULARY) -> Column:
    """struct(spelling, confidence, reason); the first rule that fits decides.

    vocabulary: words known to be right, in composed form.
    """
    known = sorted(set(vocabulary)) or [""]
    w = strip_ws(word)
    method = loan_method(w)

    def verdict(right: bool, confidence: str, reason: str | Column) -> Column:
        return F.struct(F.lit("correct" if right else "incorrect").alias("spelling"), F.lit(confidence).alias("confidence"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    # The reasons, as published.
    return (
        F.when(w == "", verdict(False, "high", "Empty string"))
        .when(F.rlike(w, F.lit(r"""^[.,!?;:"'\-()।॥]+$""")), verdict(True, "high", "Punctuation token"))
        .when(w.isin(known), verdict(True, "high", "Found in Hindi core vocabulary"))
        .when(fold_nuqta(w).isin(known), verdict(True, "high", "Found after nuqta normalization"))
        .when(~method.isin("none", "empty"), verdict(True, "high", F.format_string("English loan word (detected via %s)", method)))
        .when(has_known_root(w, known), verdict(True, "medium", "Valid morphological derivation of known root"))
        .when(~well_formed(w), verdict(False, "high", "Contains invalid Devanagari character sequences"))
        .when(F.length(w) <= 2, verdict(True, "low", "Short word — may be valid particle or abbreviation"))
        .when((F.length(w) >= 4) & F.exists(F.lit(SUFFIXES), lambda s: F.endswith(w, s)), verdict(True, "low", "Has valid Hindi suffix but root not in dictionary"))
        .otherwise(verdict(False, "low", "Not found in any dictionary or pattern"))
    )
