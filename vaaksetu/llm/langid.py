"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bound_batches, fresh

#: n-grams of 1 to 3 characters, within words; a word is padded with one mark on each side. A character takes BITS bits of a key.
ORDERS, BITS = 3, 21
#: Ranks that a profile, of a language or of a document, has.
TOP = 400
#: Profiles go to every task, so the number of languages has a bound.
MAX_LANGUAGES = 2000
#: Characters counted at a time, and distinct n-grams that a training task sums before it hands them on.
_CHUNK, _FLUSH = 1 << 20, 2_000_000
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _sums(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs."""
    if n is None:
        keys = np.sort(keys)
    else:
        by = np.argsort(keys, kind="stable")
        keys, n = keys[by], n[by]
    if not len(keys):
        return keys, np.array([], np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n, first)


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of a whole text's n-grams, keys ascending: the order of the n-grams' characters, the mark first.

    A key has the characters from the highest bits down; the mark is 0, as are unused places below. Letters are taken small; any other
    character ends a word.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(is_letter()[c], c, 0)
    c = np.concatenate(([0], c, [0])).astype(np.int64)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    keys, n = np.array([], np.int64), np.array([], np.int64)
    for i in range(0, len(c), _CHUNK):
        x, y, z = c[i : i + _CHUNK], c[i + 1 : i + 1 + _CHUNK], c[i + 2 : i + 2 + _CHUNK]
        one = x << 2 * BITS
        two = one[: len(y)] | y << BITS
        three = two[: len(z)] | z
        found = np.concatenate([one[x > 0], two[(y > 0) | (x[: len(y)] > 0)], three[y[: len(z)] > 0]])
        k, m = _sums(found)
        keys, n = (k, m) if i == 0 else _sums(np.concatenate([keys, k]), np.concatenate([n, m]))
    return keys, n


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder `fold`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def train_profiles(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, dict[int, int]]:
    """language -> n-gram's key -> rank from 0, from all rows whose text and language aren't null.

    Tasks count n-grams by language over whole texts and hand on sums; these are added up by (language, n-gram)
    and each language's most frequent `top` are kept, ties in order of the key. What reaches the driver is at most `top` rows a language.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def settle() -> pd.DataFrame:
            parts = []
            for lang, found in waiting.items():
                k, n = _sums(*map(np.concatenate, zip(*found)))
                parts.append(pd.DataFrame({"lang": lang, "gram": k, "n": n}))
            waiting.clear()
            return pd.concat(parts) if parts else pd.DataFrame({"lang": np.array([], object), "gram": np.array([], np.int64), "n": np.array([], np.int64)})

        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                got = count_grams(text)
                waiting.setdefault(lang, []).append(got)
                size += len(got[0])
                if size > _FLUSH:
                    yield settle()
                    size = 0
        yield settle()

    bound_batches(rows.sparkSession)
    known = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = known.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = sums.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < top)
    found = best.limit(top * MAX_LANGUAGES + 1).collect()
    if len(found) > top * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, dict[int, int]] = {}
    for r in found:
        profiles.setdefault(r.lang, {})[r.gram] = r["rank"]
    return profiles


def out_of_place(ranks: list[int], profile: dict[int, int], top: int = TOP) -> int:
    """Sum over a document's ranked n-grams of how far each is from its place in the profile, `top` if it isn't there."""
    return sum(abs(profile[g] - i) if g in profile else top for i, g in enumerate(ranks))


def predict(docs: DataFrame, profiles: dict[str, dict[int, int]], text_col: str = "text", top: int = TOP, into: str = "_lid") -> DataFrame:
    """docs with a struct `into` of lang_pred and score.

    The document's `top` most frequent n-grams, ties in order of the key, are compared with every profile; the
    language with the smallest out-of-place distance wins, ties going to the name first in order. score is 1 less the
    winning distance as a share of the largest one possible. Null texts, texts without a letter, and any text where
    no language was learned, give 'und' with score 0. Only the text column is looked at.
    """
    bound_batches(docs.sparkSession)
    langs = sorted(profiles)
    known = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    place = np.full((len(known) + 1, len(langs)), -1, np.int64)
    for j, lang in enumerate(langs):
        place[np.searchsorted(known, list(profiles[lang])), j] = list(profiles[lang].values())

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranks = np.arange(top)[:, None]
        for texts in batches:
            out = []
            for text in texts:
                keys, n = count_grams(text) if text and langs else ((), ())
                if not len(keys):
                    out.append(("und", 0.0))
                    continue
                first = keys[np.argsort(-n, kind="stable")[:top]]
                at = np.searchsorted(known, first)
                at[known[np.minimum(at, len(known) - 1)] != first] = len(known)
                where = place[at]
                far = np.where(where >= 0, np.abs(where - ranks[: len(first)]), top).sum(axis=0)
                j = int(far.argmin())
                out.append((langs[j], 1 - float(far[j]) / (top * len(first))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    # Not deterministic in the optimizer's eyes, so that a filter on the result doesn't compute it a second time.
    return docs.withColumn(into, udf.asNondeterministic()(F.col(text_col)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score, profiles being learned from the rows that aren't held out. Columns of docs with these names are replaced.

    Null ids count as empty text when rows are held out; rows without a text or a language teach nothing; repeated rows count each
    time. Null and empty texts, and all texts where nothing was learned, are 'und'. An empty table gives an empty one.
    """
    out, lid = held_out(docs[id_col]), fresh("_lid", docs)
    got = predict(docs, train_profiles(docs.where(~out), text_col, lang_col), text_col, into=lid)
    return got.withColumns({"held_out": held_out(got[id_col]), "lang_pred": F.col(f"{lid}.lang_pred"), "score": F.col(f"{lid}.score")}).drop(lid)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is known, that is not 'und', with the predicted language for their own label; other columns are left as they are.

    Null and empty texts and texts without a letter go. Rows that repeat, null ids included, are kept as often as they occur; an
    empty table, or one where nothing can be learned, gives an empty one.
    """
    lid = fresh("_lid", docs)
    got = predict(docs, train_profiles(docs.where(~held_out(docs[id_col])), text_col, lang_col), text_col, into=lid)
    return got.where(F.col(f"{lid}.lang_pred") != "und").select(*[F.col(f"{lid}.lang_pred").alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])


def crc_fold(doc_id: int | None, folds: int = 3) -> int:
    """held_out's remainder in plain Python."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds
