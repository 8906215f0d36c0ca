"""Fuzzy passages that documents share: k-mer seeds, collinear chaining through a Fenwick tree, alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, stage, unstage, words_of

#: Words of a seed, and consecutive seeds of which the one with the least hash stands for all: any K + WINDOW - 1 words in common share one.
K, WINDOW = 5, 12
#: A chained seed's worth, and what each word between two chained seeds costs, half of it for either text.
WORTH, GAP_COST = 5.0, 0.2
#: Words without a seed after which a chain is cut: what lies beyond is a passage of its own.
MAX_GAP = 40
#: Words on either side of a chain that alignment looks at first; where they agree to the end, it looks at so many times as many, and so on.
REACH, FARTHER = 4 * (K + WINDOW), 24
#: Rounds in which keys grow, each by a seed or more: a run of 50 shared words has about eight seeds.
LEVELS = 8
#: Places of seeds in two texts.
PLACES = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType())]))
#: Parts that seeds and texts are dealt with in.
PARTS = 2


def word_hashes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def least_places(values: np.ndarray, window: int) -> np.ndarray:
    """The place of the least value, ties to the left, of each `window` consecutive ones: of windows that grow by up to their own length a step."""
    best, at, have = values, np.arange(len(values)), 1
    while have < window:
        step = min(have, window - have)
        right = best[step:] < best[:-step]
        best, at = np.where(right, best[step:], best[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


def seeds_of(h: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the seeds of a text: the least k-mer hash, ties to the left, of each `window` consecutive k-mers."""
    n = len(h) - k + 1
    if n <= 0:
        return np.array([], np.uint64), np.array([], np.int64)
    mer = h[:n].copy()
    for i in range(1, k):
        mer = mer * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    mer ^= mer >> np.uint64(29)
    mer *= np.uint64(0xBF58476D1CE4E5B9)
    mer ^= mer >> np.uint64(32)
    w = min(window, n)
    at: list[np.ndarray] = []
    for i in range(0, n - w + 1, 1 << 16):
        at.append(i + least_places(mer[i : i + (1 << 16) + w - 1], w))
    pos = np.concatenate(at)
    pos = pos[np.append(True, pos[1:] != pos[:-1])]
    return mer[pos], pos


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, places, firsts, size = [], [], [], [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(firsts))], ["h", "id", "pos", "first"])

        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            h, pos = seeds_of(word_hashes(text.as_py()))
            ids.append(np.full(len(pos), doc_id, np.int64))
            hashes.append(h)
            places.append(pos)
            firsts.append(np.zeros(len(pos), bool))
            firsts[-1][np.unique(h, return_index=True)[1]] = True
            size += len(pos)
            if size > 200_000:
                yield rows()
                ids, hashes, places, firsts, size = [], [], [], [], 0
        if ids:
            yield rows()


class Fenwick:
    """Prefix maxima of (score, index)."""

    def __init__(self, n: int):
        self.n, self.best, self.who = n, [float("-inf")] * (n + 1), [-1] * (n + 1)

    def raise_to(self, i: int, score: float, who: int) -> None:
        i += 1
        while i <= self.n:
            if score > self.best[i]:
                self.best[i], self.who[i] = score, who
            i += i & -i

    def before(self, i: int) -> tuple[float, int]:
        score, who = float("-inf"), -1
        while i > 0:
            if self.best[i] > score:
                score, who = self.best[i], self.who[i]
            i -= i & -i
        return score, who


def chains(pairs: list[tuple[int, int]], least: int = 2) -> list[list[tuple[int, int]]]:
    """Disjoint chains of matches (place here, place there) that ascend in both texts, best first, cut at gaps over MAX_GAP.

    A match is worth WORTH, and following another costs GAP_COST / 2 for each word passed in either text; as that cost is a
    difference of sums, the best match to follow is a prefix maximum over the other text's places, in a Fenwick tree.
    """
    pairs = sorted(set(pairs))
    score, back = [WORTH] * len(pairs), [-1] * len(pairs)
    i = 0
    if all(a < b and x < y for (a, x), (b, y) in pairwise(pairs)):
        # Where all matches ascend, the best one to follow is the one before, and no tree is asked.
        for i in range(1, len(pairs)):
            gain = score[i - 1] + GAP_COST / 2 * sum(pairs[i - 1]) - GAP_COST / 2 * sum(pairs[i])
            if gain > 0:
                score[i], back[i] = WORTH + gain, i - 1
        i = len(pairs)
    rank = {q: n for n, q in enumerate(sorted({q for _, q in pairs[i:]}))}
    tree = Fenwick(len(rank))
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            p, q = pairs[j]
            best, who = tree.before(rank[q])
            gain = best - GAP_COST / 2 * (p + q)
            score[j], back[j] = (WORTH + gain, who) if gain > 0 else (WORTH, -1)
            j += 1
        for n in range(i, j):
            p, q = pairs[n]
            tree.raise_to(rank[q], score[n] + GAP_COST / 2 * (p + q), n)
        i = j
    used, out = [False] * len(pairs), []
    for end in sorted(range(len(pairs)), key=lambda n: (-score[n], n)):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(pairs[end])
            end = back[end]
        chain.reverse()
        start = 0
        for n in range(1, len(chain) + 1):
            if n == len(chain) or max(chain[n][0] - chain[n - 1][0], chain[n][1] - chain[n - 1][1]) > MAX_GAP + K:
                if n - start >= least:
                    out.append(chain[start:n])
                start = n
    return out


def _same(a: list, b: list) -> int:
    """Words that stay in a cheapest alignment of two short stretches."""
    if a == b:
        return len(a)
    # Words that agree at either end stay in a cheapest alignment.
    least, ends = min(len(a), len(b)), 0
    while ends < least and a[ends] == b[ends]:
        ends += 1
    a, b, least = a[ends:], b[ends:], least - ends
    n = 0
    while n < least and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b, ends = a[: len(a) - n], b[: len(b) - n], ends + n
    if len(a) <= 1 or len(b) <= 1:
        return ends + (a[0] in b if len(a) == 1 else bool(a) and bool(b) and b[0] in a)
    row = [(j, 0) for j in range(len(b) + 1)]  # (cost, -kept words)
    for i, x in enumerate(a, 1):
        new = [(i, 0)]
        for j, y in enumerate(b, 1):
            c, k = row[j - 1]
            new.append(min((c, k - 1) if x == y else (c + 1, k), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return ends - row[-1][1]


#: Words that may differ before two stretches agree again, in either text, likeliest first.
_STEPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 0), (0, 2), (2, 1), (1, 2), (3, 3), (4, 4), (5, 5), (3, 0), (0, 3))
#: Words that steps look at.
_NEAR = max(map(max, _STEPS)) + 3


def _agree(a: np.ndarray, b: np.ndarray, i: int, j: int, n: int) -> int:
    """For how many of n words a from i on and b from j on agree, looked for in pieces that grow."""
    run, size = 0, 32
    while run < n:
        m = min(size, n - run)
        differ = a[i + run : i + run + m] != b[j + run : j + run + m]
        first = int(differ.argmax())
        if differ[first]:
            return run + first
        run, size = run + m, 4 * size
    return n


def _extend(a: np.ndarray, b: np.ndarray, credit: int) -> tuple[int, int, int, int, bool]:
    """How far two stretches agree from their beginning: words of a, words of b, words kept, edits, whether the end of either was reached.

    Stretches agree as long as edits, four kept words each, aren't more than the words kept so far and the credit of what they extend.
    """
    i = j = kept = edits = 0
    best = (0, 0, 0, 0)
    while True:
        n = min(len(a) - i, len(b) - j)
        run = _agree(a, b, i, j, n)
        i, j, kept = i + run, j + run, kept + run
        if run and kept + credit >= 4 * edits:
            best = (i, j, kept, edits)
        if run == n or 4 * edits > kept + credit + 12:
            return *best, run == n
        near, there = a[i : i + _NEAR].tolist(), b[j : j + _NEAR].tolist()
        for x, y in _STEPS:
            if x + 3 <= len(near) and y + 3 <= len(there) and near[x : x + 3] == there[y : y + 3]:
                i, j, edits = i + x, j + y, edits + max(x, y)
                break
        else:
            return *best, min(len(a) - i, len(b) - j) < 8


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]]) -> tuple[int, int, int, int, int, bool]:
    """(start, end, other start, other end, kept words, open) of the passage around a chain of seeds of K words; open: the given words end before the passage surely does."""
    (i, j), kept = chain[0], K
    start, other = i, j
    i, j = i + K, j + K
    for p, q in chain[1:]:
        shift = max(i - p, j - q, 0)
        if shift >= K:
            continue
        p, q = p + shift, q + shift
        kept += (_same(a[i:p].tolist(), b[j:q].tolist()) if (p - i, q - j) != (0, 0) else 0) + K - shift
        i, j = p + K - shift, q + K - shift
    credit = 5 * kept - 4 * max(i - start, j - other)
    x, y, k, lost, right = _extend(a[i:], b[j:], credit)
    u, v, m, _, left = _extend(a[:start][::-1], b[:other][::-1], credit + k - 4 * lost)
    return start - u, i + x, other - v, j + y, kept + k + m, left or right


def _with_anchors(items: DataFrame) -> DataFrame:
    """Items (h, id, pos, first, offs), offs being the distances of the key's seeds from its first, whose key other documents have too, with the first of them and its first place: (to, q).

    first: whether a place is the key's first in the document, so one row of the anchor is asked for its place.
    """
    anchors = items.where("first").groupBy("h").agg(F.min("id").alias("to"), F.min_by("pos", "id").alias("q"), F.count("*").alias("docs")).where("docs > 1").select(F.col("h").alias("anchor_h"), "to", "q")
    return items.join(anchors, F.col("h") == F.col("anchor_h")).drop("anchor_h")


def _joined(shared: DataFrame, passages: DataFrame) -> DataFrame:
    """Longer keys: two successive shared items of a document, and their distance, where the second isn't at that distance in the first one's anchor and no known passage has both."""
    w = Window.partitionBy("id").orderBy("pos", "h")
    after = lambda c: F.lead(c).over(w).alias(f"next_{c}")
    two = shared.select("h", "id", "pos", "offs", "to", "q", *[after(c) for c in ("h", "pos", "offs", "to", "q")])
    gap = F.col("next_pos") - F.col("pos")
    two = two.where(gap.between(1, MAX_GAP + K) & ((F.col("to") != F.col("next_to")) | (F.col("next_q") - F.col("q") != gap)))
    two = two.withColumn("last", F.col("next_pos") + F.element_at("next_offs", -1) + K)
    two = two.join(passages.select(F.col("id").alias("of"), "s", "e"), (F.col("id") == F.col("of")) & (F.col("s") <= F.col("pos")) & (F.col("last") <= F.col("e")), "left_anti")
    keys = two.select(F.xxhash64("h", "next_h", gap).alias("h"), "id", "pos", F.sort_array(F.array_union("offs", F.transform("next_offs", lambda o: o + gap))).alias("offs"))
    return keys.withColumn("first", F.row_number().over(Window.partitionBy("id", "h").orderBy("pos")) == 1)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive words, from sums of the words' hashes times powers of an odd number."""
    if len(h) < size:
        return np.array([], np.uint64)
    base = 0x9E3779B97F4A7C15
    powers, back = (np.cumprod(np.append(np.uint64(1), np.full(len(h), b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
    sums = np.append(np.uint64(0), np.cumsum(h * powers[:-1], dtype=np.uint64))
    out = (sums[size:] - sums[:-size]) * back[: len(h) - size + 1]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _whole_windows(short: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """Keys (h, id, pos, first) of all stretches of `size` words that meet one of the stretches (id, s, e)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                h = window_hashes(word_hashes(text.as_py()), size)
                wanted = np.zeros(len(h), bool)
                for x in at:
                    wanted[max(0, x["s"] - size + 1) : x["e"]] = True
                pos = np.flatnonzero(wanted)
                first = np.zeros(len(pos), bool)
                first[np.unique(h[pos], return_index=True)[1]] = True
                for i in range(0, len(pos), 200_000):
                    j = pos[i : i + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(h[j].view(np.int64)), pa.array(np.full(len(j), doc_id, np.int64)), pa.array(j.astype(np.int32)), pa.array(first[i : i + 200_000])], ["h", "id", "pos", "first"])

    at = short.distinct().groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("at"))
    return known.join(at, "id").select("id", "text", "at").mapInArrow(rows, "h long, id long, pos int, first boolean")


def _one_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with one row an id: where an id's rows differ in text, the least text stands for it."""
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    again = stage(known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    if again.isEmpty():
        return known
    return known.join(again, "id", "left_anti").unionByName(known.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))


@F.pandas_udf(T.ArrayType(PLACES))
def _chained(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ps, qs in batches:
        yield pd.Series([[[{"p": p, "q": q} for p, q in c] for c in chains(list(zip(p.tolist(), q.tolist())))] for p, q in zip(ps, qs)])


@F.pandas_udf(T.BinaryType())
def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([word_hashes(t).astype("<u4").tobytes() for t in texts])


def _verified(found: DataFrame, words: DataFrame, reach: int) -> DataFrame:
    """Chains with what alignment makes of them: s, e, t, u, kept, sim, open. `reach` words on either side of a chain are looked at."""

    @F.pandas_udf("struct<s:int,e:int,t:int,u:int,kept:int,sim:double,open:boolean>")
    def aligned(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for a, b, a_lo, b_lo, ps, qs, a_n, b_n in batches:
            out = []
            for x, y, lo, to_lo, p, q, n, m in zip(a, b, a_lo, b_lo, ps, qs, a_n, b_n):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                s, e, t, u, kept, more = align(x, y, [(i - lo, j - to_lo) for i, j in zip(p.tolist(), q.tolist())])
                # The words end with the text itself, or only with what was cut out of it.
                more = more and (min(lo, to_lo) > 0 or (lo + len(x) < n and to_lo + len(y) < m))
                out.append((lo + s, lo + e, to_lo + t, to_lo + u, kept, kept / max(e - s, u - t), more))
            yield pd.DataFrame(out, columns=["s", "e", "t", "u", "kept", "sim", "open"])

    ends = lambda f: (F.get(F.col("c"), 0)[f], F.get(F.col("c"), F.size("c") - 1)[f])
    (p0, p1), (q0, q1) = ends("p"), ends("q")
    span = lambda here, of, first, last: found.select("chain", F.lit(here).alias("here"), F.col(of).alias("of"), F.greatest(F.lit(0), first - reach).alias("lo"), (last + K + reach).alias("hi"), "c")
    asked = span(True, "id", p0, p1).unionByName(span(False, "to", q0, q1).withColumn("c", F.lit(None).cast(PLACES)))
    cut = asked.join(words, F.col("of") == F.col("word_id")).select("chain", "here", "of", "lo", "c", (F.octet_length("words") / 4).cast("int").alias("n"), F.substring("words", 4 * F.col("lo") + 1, 4 * (F.col("hi") - F.col("lo"))).alias("w"))
    side = lambda h: F.max(F.when(F.col("here") == h, F.struct("of", "lo", "n", "w")))
    paired = cut.groupBy("chain").agg(side(True).alias("a"), side(False).alias("b"), F.max("c").alias("c"))
    # Not deterministic in the optimizer's eyes, so that filters on the result don't compute it a second time.
    done = paired.select("chain", F.col("a.of").alias("id"), F.col("b.of").alias("to"), "c", aligned.asNondeterministic()("a.w", "b.w", "a.lo", "b.lo", "c.p", "c.q", "a.n", "b.n").alias("r"))
    return done.select("chain", "id", "to", "c", "r.*")


def _passages(matches: DataFrame, known: DataFrame) -> DataFrame:
    """Aligned chains of places that pairs of documents have in common: id, to, s, e, t, u, kept, sim."""
    both = matches.groupBy("id", "to").agg(F.collect_list("m").alias("m")).where(F.size("m") > 1)
    chained = both.select("id", "to", F.explode(_chained(F.col("m.p"), F.col("m.q"))).alias("c"))
    found = chains_ = stage(chained.select("id", "to", F.xxhash64("id", "to", F.get("c", F.lit(0)).p, F.get("c", F.lit(0)).q).alias("chain"), "c"), "chains")
    wanted = found.select("id").union(found.select(F.col("to").alias("id"))).distinct()
    # Whole texts are shuffled here, so they too are dealt with in parts. An id is there once, so the ids are what is hashed and texts needn't be sorted.
    share = [F.pmod("id", F.lit(PARTS)) == i for i in range(PARTS)]
    staged = [stage(known.where(s).join(wanted.where(s).hint("shuffle_hash"), "id", "left_semi").select(F.col("id").alias("word_id"), _hashed("text").alias("words")), "words") for s in share]
    words = reduce(DataFrame.union, staged)
    reach, parts = REACH, []
    while True:
        got = stage(_verified(found, words, reach), "aligned")
        parts.append(got.where("not open"))
        found = got.where("open").select("id", "to", "chain", "c")
        if found.isEmpty():
            break
        reach *= FARTHER
    unstage(chains_, *staged)
    return reduce(DataFrame.union, parts).select("id", "to", "s", "e", "t", "u", "kept", "sim")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """Passages that a document shares with an earlier one: (doc_id, partner_id, start, end, partner_start, partner_end, kept, similarity), in words.

    Every seed of every whole text is counted. The document with the smallest id that has a seed is its anchor and is
    joined with the other documents that have it, so a seed in very many documents makes as many rows as it has places, not
    pairs: the passages of a group of documents form a star around its first. Where the anchors of successive seeds don't
    continue each other, and no passage found so far has both, the two seeds together are a key with an anchor of its own, and so on with longer keys, up to
    LEVELS rounds (a document that has a longer key more than once is joined at the first place): so a run of seeds that no earlier document has in this order is compared with its own first document. Where what a document has in common with an anchor is no passage, all stretches of
    min_words words that meet it are keys too, with anchors of their own, so that documents that share such a stretch word for word are linked
    though an earlier document has just a part of it. Seeds of two documents are chained, and each
    chain is aligned on the words around it, as far as they agree; a passage has min_words words or more in both texts, of which the share
    `similarity` is kept in the longer one. Null and shorter texts have no passages, rows without an id are left out,
    and rows that share an id are one document, of their least text. Repeats within one document aren't passages here; an empty
    table has no passages.
    """
    bound_batches(docs.sparkSession)
    known = _one_text(docs, id_col, text_col)
    place = F.struct((F.col("pos") + F.col("o")).alias("p"), (F.col("q") + F.col("o")).alias("q"))
    pairs = lambda shared: shared.where("id > to").select("id", "to", "pos", "q", F.explode("offs").alias("o")).select("id", "to", place.alias("m"))
    fits = (F.col("e") - F.col("s") >= min_words) & (F.col("u") - F.col("t") >= min_words) & (F.col("sim") >= similarity)
    seeds = stage(known.mapInArrow(_seed_rows, "h long, id long, pos int, first boolean"), "seeds")
    # Seeds are dealt with in parts, one after the other, so that just one part's shuffle files are on disk at a time.
    parts = [stage(_with_anchors(seeds.where(F.pmod("h", F.lit(PARTS)) == i)), "shared") for i in range(PARTS)]
    unstage(seeds)
    shared = reduce(DataFrame.union, parts)
    alone = shared.where("id > to").select("id", "to", F.struct(F.col("pos").alias("p"), "q").alias("m"))
    chained = _passages(alone, known)
    first = stage(chained.where(fits), "passages")
    shared = shared.withColumn("offs", F.array(F.lit(0)))
    levels = []
    for _ in range(LEVELS):
        items = stage(_joined(shared, first), "keys")
        if items.isEmpty():
            unstage(items)
            break
        if levels:
            levels[-1] = stage(levels[-1], "matches")
        unstage(*parts)
        parts = [shared := stage(_with_anchors(items), "shared")]
        unstage(items)
        levels.append(pairs(shared.where("first")))
    found = [first]
    if levels:
        more = _passages(reduce(DataFrame.union, levels), known)
        found.append(more.where(fits))
        chained = chained.union(more)
    # What a document has in common with an anchor may be too short or unlike, and longer in another document that has the same anchor.
    short = chained.where(~fits)
    short = short.select("id", "s", "e").union(short.select(F.col("to").alias("id"), F.col("t").alias("s"), F.col("u").alias("e")))
    windows = stage(_whole_windows(short, known, max(min_words, K + 1)), "windows")
    across = sorted({*range(0, max(min_words, K + 1) - K, MAX_GAP), max(min_words, K + 1) - K})
    whole = stage(pairs(_with_anchors(windows).withColumn("offs", F.array(*map(F.lit, across)))), "matches")
    if not whole.isEmpty():
        found.append(_passages(whole, known).where(fits))
    unstage(windows, whole)
    done = reduce(DataFrame.union, found).select(F.col("id").alias("doc_id"), F.col("to").alias("partner_id"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("t").alias("partner_start"), F.col("u").alias("partner_end"), "kept", F.col("sim").alias("similarity"))
    return done.distinct()
