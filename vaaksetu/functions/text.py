"""Unicode-aware text functions, Column -> Column. A null text gives null."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it; Java's \s is ASCII only.
WS = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DEVANAGARI = r"\u0900-\u097F"
#: Characters that composition could change: none before the combining marks, nor common punctuation.
COMPOSABLE = r"[^\x00-\u02ff\u2010-\u205e]"
#: Characters deleted before words are aligned.
ALIGN_DROP = r"""[।,.!?;:"'\-()\[\]]"""


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def tokens(text: Column) -> Column:
    """Words between white space; never an empty one."""
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


@F.pandas_udf(T.StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition, for which Spark has no function."""
    for texts in batches:
        yield texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def clean_text(text: Column, normalize: bool = True) -> Column:
    """Keeps Devanagari, ASCII letters and digits; anything else becomes white space, which is squeezed. Case stays.

    Composition is the only step in Python; texts without a character that it could change aren't sent there. normalize=False
    skips it for text known to be composed.
    """
    if normalize:
        text = F.coalesce(nfc(F.when(F.rlike(text, F.lit(COMPOSABLE)), text)), text)
    return squeeze(F.regexp_replace(text, f"[^{DEVANAGARI}{WS}a-zA-Z0-9]", " "))


def align_tokens(text: Column) -> Column:
    """Words after deleting punctuation, so hyphenated pairs become one word."""
    return tokens(F.regexp_replace(text, ALIGN_DROP, ""))


def devanagari_only(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{DEVANAGARI}]", "")


def fold_nuqta(text: Column) -> Column:
    """The letters za, pha, ra and rha without their dot."""
    for dotted, plain in (("ज़", "ज"), ("फ़", "फ"), ("ड़", "ड"), ("ढ़", "ढ")):
        text = F.replace(text, F.lit(dotted), F.lit(plain))
    return text


def split_core(token: Column, keep_danda: bool = True) -> Column:
    """struct(prefix, core, suffix): the core starts and ends with a letter or Devanagari; a token without one is all core.

    The danda is Devanagari and stays in the core unless keep_danda is False.
    """
    edge = rf"[^{DEVANAGARI}\p{{L}}]" if keep_danda else rf"(?:[^{DEVANAGARI}\p{{L}}]|[।॥])"
    pattern = rf"(?s)^({edge}*)(.*?)({edge}*)$"
    part = lambda i: F.regexp_extract(token, pattern, i)
    bare = part(2) == ""
    return F.struct(F.when(bare, "").otherwise(part(1)).alias("prefix"), F.when(bare, token).otherwise(part(2)).alias("core"), F.when(bare, "").otherwise(part(3)).alias("suffix"))


def rewrite_url(url: Column, old: str, new: str) -> Column:
    return F.replace(url, F.lit(old), F.lit(new))


def shorten(text: Column, n: int) -> Column:
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


def missing(text: Column) -> Column:
    """Whether a table's cell counts as missing: null, blank, or the text nan."""
    t = strip_ws(text)
    return text.isNull() | (t == "") | (t == "nan")
