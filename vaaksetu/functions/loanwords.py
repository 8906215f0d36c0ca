"""English loan words in Devanagari: transliteration, detection, tagging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ENGLISH, LOANS, ROMAN, ROMAN_PAIRS
from .text import devanagari_only, split_core, tokens

#: A word that romanises to something with the first four letters of an English word may be a form of it.
STEM = 4
_STEMS = sorted({w[:STEM] for w in ENGLISH if len(w) >= STEM})


def romanize(word: Column) -> Column:
    """Devanagari to Roman letters, without inherent vowels; other characters stay, all in small letters."""
    for pair, roman in ROMAN_PAIRS.items():
        word = F.replace(word, F.lit(pair), F.lit(roman))
    table = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    return F.lower(F.array_join(F.transform(F.split(word, ""), lambda c: F.coalesce(F.element_at(table, c), c)), ""))


def loan_method(word: Column) -> Column:
    """How a word is known to be a loan: dictionary, transliteration, fuzzy_transliteration; or none, or empty if it has no Devanagari."""
    w = devanagari_only(word)
    roman = romanize(w)
    return (
        F.when(w == "", "empty")
        .when(w.isin(sorted(LOANS)), "dictionary")
        .when(roman.isin(sorted(ENGLISH)), "transliteration")
        .when((F.length(roman) >= STEM) & F.substring(roman, 1, STEM).isin(_STEMS), "fuzzy_transliteration")
        .otherwise("none")
    )


def is_loan(word: Column) -> Column:
    return ~loan_method(word).isin("none", "empty")


def tag_loans(text: Column, keep_danda: bool = True) -> Column:
    """Loan words between [EN] and [/EN], punctuation outside; white space becomes single spaces."""

    def tag(token: Column) -> Column:
        s = split_core(token, keep_danda)
        return F.when(is_loan(s.core), F.concat(s.prefix, F.lit("[EN]"), s.core, F.lit("[/EN]"), s.suffix)).otherwise(token)

    return F.array_join(F.transform(tokens(text), tag), " ")
