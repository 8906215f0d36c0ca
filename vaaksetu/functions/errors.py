"""Predicates on (reference, prediction) and the categories they give."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CATEGORIES, HOMOPHONES, MISMATCH_WORDS, REASONS
from .text import WS, strip_ws, tokens


def punctuation_only(ref: Column, pred: Column, keep_signs: bool = False) -> Column:
    """Equal once everything but letters, numbers and white space is deleted. Vowel signs aren't letters, so they are
    deleted too unless keep_signs is set."""
    kept = r"\p{L}\p{N}_" + (r"\p{M}" if keep_signs else "")
    bare = lambda t: strip_ws(F.regexp_replace(t, f"[^{kept}{WS}]", ""))
    return bare(ref) == bare(pred)


def number_mismatch(ref: Column, pred: Column) -> Column:
    """A number word on one side only, or digits in the prediction alone."""
    a, b = tokens(ref), tokens(pred)
    differ = F.array_union(F.array_except(a, b), F.array_except(b, a))
    digits = lambda t: F.rlike(t, F.lit(r"\p{Nd}"))
    return F.arrays_overlap(differ, F.lit(MISMATCH_WORDS)) | (digits(pred) & ~digits(ref))


def loan_script(ref: Column, pred: Column) -> Column:
    """Two Latin letters in a row on exactly one side."""
    latin = lambda t: F.rlike(t, F.lit("[a-zA-Z]{2,}"))
    return latin(ref) != latin(pred)


def homophone(ref: Column, pred: Column, whole_words: bool = False) -> Column:
    """One of a pair within the reference and the other within the prediction; as parts of words too, unless whole_words is set."""
    if whole_words:
        a, b = tokens(ref), tokens(pred)
        within = lambda side, w: F.array_contains(a if side else b, w)
    else:
        within = lambda side, w: F.contains(ref if side else pred, F.lit(w))
    return reduce(lambda x, y: x | y, [(within(True, p) & within(False, q)) | (within(True, q) & within(False, p)) for p, q in HOMOPHONES])


def repetition(ref: Column, pred: Column) -> Column:
    """Two equal words side by side in the prediction."""
    w = tokens(pred)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: x == y)
    return F.when(F.size(w) < 2, F.lit(False)).otherwise(F.exists(pairs, lambda x: x))


def deletion(ref: Column, pred: Column) -> Column:
    return F.size(tokens(pred)) < F.size(tokens(ref)) * 0.7


def insertion(ref: Column, pred: Column) -> Column:
    return F.size(tokens(pred)) > F.size(tokens(ref)) * 1.3


PREDICATES: dict[str, Callable[[Column, Column], Column]] = dict(zip(CATEGORIES, [punctuation_only, number_mismatch, loan_script, homophone, repetition, deletion, insertion]))


def classify_error(ref: Column, pred: Column, predicates: dict[str, Callable[[Column, Column], Column]] | None = None) -> Column:
    """Names of all predicates that hold, in their order; ['Other'] if none does. predicates may be extended or replaced."""
    names = F.array_compact(F.array(*[F.when(p(ref, pred), F.lit(name)) for name, p in (predicates or PREDICATES).items()]))
    return F.when(F.size(names) == 0, F.array(F.lit("Other"))).otherwise(names)


def reason_for(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(F.element_at(table, category), F.lit(REASONS["Other"]))
