"""Word edits and word error rates, in expressions that stay in the JVM; lattice edits, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip_ws, tokens

#: First code point given to a word; those from here up to the last one are all valid.
_FIRST = 0x10000


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row: what stands within a lambda is otherwise computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _as_text(words: Column, known: Column) -> Column:
    """Each word as one character: its place among the distinct words of the pair."""
    codes = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(known, w) + _FIRST - 1), 8, "0"))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")


def word_edits(ref: Column, hyp: Column) -> Column:
    """Least number of words to insert, delete or replace between two arrays of words.

    Words become single characters, so that the built-in levenshtein counts words. Takes time in proportion to the product of both lengths.
    """
    both = F.struct(ref.alias("r"), hyp.alias("h"), F.array_distinct(F.concat(ref, hyp)).alias("known"))
    return bind(both, lambda x: F.levenshtein(_as_text(x.r, x.known), _as_text(x.h, x.known)).cast("long"))


def _rate(edits: Column, n_ref: Column, n_hyp: Column) -> Column:
    return F.when(n_ref > 0, edits / n_ref).otherwise(F.when(n_hyp == 0, 0.0).otherwise(F.lit(float("inf"))))


def standard_wer(ref: Column, hyp: Column) -> Column:
    """Edits by reference length; without a reference 0 if there is no hypothesis either, else infinite."""
    return _rate(word_edits(ref, hyp), F.size(ref), F.size(hyp))


def sample_wer(ref: Column, pred: Column) -> Column:
    """WER of two texts by white space alone; 0 where the reference is blank."""
    return F.when(strip_ws(ref) == "", F.lit(0.0)).otherwise(standard_wer(tokens(ref), tokens(pred)))


def _bin_edits(bins: Sequence[Sequence[str]], hyp: Sequence[str]) -> int:
    where: dict[str, list[int]] = {}
    for j, w in enumerate(hyp):
        where.setdefault(w, []).append(j)
    place = np.arange(len(hyp) + 1)
    row = place
    for accepted in bins:
        cost = np.ones(len(hyp), np.int64)
        for w in accepted:
            cost[where.get(w, [])] = 0
        new = row + 1
        np.minimum(new[1:], row[:-1] + cost, out=new[1:])
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])


@F.pandas_udf(T.LongType())
def lattice_edits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Least edits between a hypothesis and an array of bins (arrays of accepted words): a word is free where its bin has it.

    Columns: bins, hypothesis. In Arrow batches, a row of the table at a time: expressions would copy the row for each of its cells.
    """
    for bins, hyps in batches:
        yield pd.Series([None if b is None or h is None else _bin_edits(b, h) for b, h in zip(bins, hyps)], dtype="Int64")


def lattice_wer(bins: Column, hyp: Column) -> Column:
    return _rate(lattice_edits(bins, hyp), F.size(bins), F.size(hyp))
