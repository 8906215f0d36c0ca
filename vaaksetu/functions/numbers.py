"""Hindi number words to digits and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import APPROXIMATE, IDIOMS, NUMBER_WORDS, TENS, UNITS
from .text import WS
from .wer import bind


def _run(space: str, bounded: bool = False) -> str:
    """Longest runs of number words; longer words are tried first. Unbounded ones may start or end within a word."""
    word = "(?:" + "|".join(sorted(NUMBER_WORDS, key=lambda w: (-len(w), w))) + ")"
    run = f"{word}(?:[{space}]+{word})*"
    return f"(?<![^{space}]){run}(?![^{space}])" if bounded else run


def _idioms(space: str) -> list[str]:
    return [f"[{space}]+".join(map(re.escape, i.split(" "))) for i in IDIOMS]


def _value(words: Column) -> Column:
    """Value of a run: words under 100 add up, 100 multiplies what there is, larger multipliers close a group."""
    value = lambda w: F.element_at(F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, v)]), w).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))

    def step(acc: Column, v: Column) -> Column:
        base = F.when(acc.now == 0, F.lit(1).cast("long")).otherwise(acc.now)
        big = v >= 1000
        now = F.when(big, F.lit(0).cast("long")).when(v == 100, base * 100).otherwise(acc.now + v)
        return F.struct(F.when(big, acc.total + base * v).otherwise(acc.total).alias("total"), now.alias("now"))

    return F.aggregate(F.transform(words, value), zero, step, lambda acc: acc.total + acc.now)


def _starts(gaps: Column, found: Column) -> Column:
    """Where each match starts, in characters: the lengths of gaps and matches before it."""
    pairs = F.arrays_zip(gaps.alias("g"), found.alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    walk = lambda acc, x: F.struct(
        (acc.at + F.length(x.g) + F.coalesce(F.length(x.m), F.lit(0))).alias("at"),
        F.when(x.m.isNull(), acc.out).otherwise(F.concat(acc.out, F.array(F.struct((acc.at + F.length(x.g)).alias("s"), (acc.at + F.length(x.g) + F.length(x.m)).alias("e"))))).alias("out"),
    )
    return F.aggregate(pairs, zero, walk, lambda acc: acc.out)


def normalize_numbers(text: Column, word_boundary: bool = False) -> Column:
    """Runs of number words as digits, without leaving the JVM.

    A run that starts within an idiom and a run with an approximate number stay as they are. Runs ignore word
    boundaries unless word_boundary is set, which also keeps every form listed as approximate.
    """
    return bind(text, lambda t: _normalize(t, word_boundary))


def _normalize(text: Column, word_boundary: bool) -> Column:
    run, none = _run(WS, word_boundary), F.array().cast("array<struct<s:int,e:int>>")
    idioms = [_starts(F.split(text, i, -1), F.regexp_extract_all(text, F.lit(i), F.lit(0))) for i in _idioms(WS)]
    # Few texts have an idiom: the others are matched against all of them at once and then left alone.
    spans = F.when(F.rlike(text, F.lit("|".join(_idioms(WS)))), F.concat(*idioms)).otherwise(none)
    # What is bound is computed once a row, not once a run.
    # Gaps by extraction: split would compile so large a pattern for each row. A gap more, an empty one, may stand at the end.
    gaps = F.regexp_extract_all(text, F.lit(rf"(?s)(.*?)(?:{run}|\z)"), F.lit(1))
    row = F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(run), F.lit(0)).alias("found"), spans.alias("spans"))

    def convert(m: Column, at: Column, spans: Column) -> Column:
        value = lambda words: F.when(F.arrays_overlap(words, F.lit(APPROXIMATE)), m).otherwise(_value(words).cast("string"))
        return F.when(F.exists(spans, lambda s: (s.s <= at) & (at < s.e)), m).otherwise(bind(F.split(m, f"[{WS}]+"), value))

    def rewritten(x: Column) -> Column:
        new = F.transform(F.arrays_zip(x.found.alias("m"), _starts(x.gaps, x.found).alias("p")), lambda y: convert(y.m, y.p.s, x.spans))
        return F.array_join(F.zip_with(x.gaps, new, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")

    return F.when(F.rlike(text, F.lit(run)), bind(row, rewritten)).otherwise(text)


def evaluate(words: list[str]) -> int:
    total = now = 0
    for v in map(NUMBER_WORDS.__getitem__, words):
        if v < 100:
            now += v
        elif v == 100:
            now = (now or 1) * 100
        else:
            total, now = total + (now or 1) * v, 0
    return total + now


def normalize_text(text: str | None) -> str | None:
    """normalize_numbers for one text, in Python."""
    if not text:
        return text
    spans = [m.span() for i in _idioms(r"\s") for m in re.finditer(i, text)]

    def convert(m: re.Match) -> str:
        words = m[0].split()
        if any(s <= m.start() < e for s, e in spans) or any(w in APPROXIMATE for w in words):
            return m[0]
        return str(evaluate(words))

    return _PYTHON_RUN.sub(convert, text)


_PYTHON_RUN = re.compile(_run(r"\s"))


@F.pandas_udf(T.StringType())
def normalize_numbers_arrow(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same in Arrow batches: a cross-check of the native form, and a choice for long texts."""
    for texts in batches:
        yield texts.map(normalize_text)


def spell_number(n: Column) -> Column:
    """Whole numbers from 0 to under 10^9 in Hindi words, by crores, lakhs, thousands, hundreds; each multiplier has its count before it."""
    small = F.lit([next(w for w, v in UNITS.items() if v == i) for i in range(10)] + list(TENS))
    word = lambda v: F.get(small, v.cast("int"))
    group = lambda v, name: F.when(v > 0, F.concat_ws(" ", word(v), F.lit(name)))
    n = n.cast("long")
    part = lambda d, m: F.floor(n / d) % m
    rest = n % 100
    said = F.concat_ws(" ", group(part(10_000_000, 100), "करोड़"), group(part(100_000, 100), "लाख"), group(part(1000, 100), "हज़ार"), group(part(100, 10), "सौ"), F.when((rest > 0) | (n == 0), word(rest)))
    return F.when((n >= 0) & (n < 10**9), said)
