"""Near-duplicates by the Jaccard similarity of word shingles: SimHash candidates by multi-index hashing, verified on the whole sets, then an exact prefix filter for what fingerprints leave open."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, stage, unstage
from .graph import connected_components
from .simhash import fingerprint_links, fingerprint_of, shingle_hashes

#: Bits of a set's sketch, in longs. Each shingle flips one, so two sketches differ in at most as many bits as the sets differ in shingles.
SKETCH = 512
#: Buckets that shingles are counted in, and the share of documents (1 of SAMPLE) they are counted over. Counts only order shingles: any order is exact.
BUCKETS, SAMPLE = 1 << 17, 8
#: Bits that fingerprints of candidates differ in at most, and rounds in which what the first stars leave open is compared with other sets of the largest component.
DISTANCE, ROUNDS = 3, 2
_LONGS = [f"s{i}" for i in range(SKETCH // 64)]


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; a shorter text is one shingle, a text without words has none."""
    return np.unique(np.concatenate([np.array([], np.uint64), *shingle_hashes(text, shingle)]))


def _digest(grams: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(grams.tobytes())
    return h - 2**64 if h >= 2**63 else h


def _levels(known: DataFrame, shingle: int) -> np.ndarray:
    """For each bucket of shingles how much more often than the mean it occurs, as a power of two, from a sample of the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(1):
                n += np.bincount((shingles(text.as_py(), shingle) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        often = np.flatnonzero(n > max(2, 2 * n.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(often, -1)), pa.array(np.append(n[often], n.sum()))], ["bucket", "n"])

    sums = known.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    bucket, n = sums["bucket"].to_numpy(np.int64), sums["n"].to_numpy(np.float64)
    mean = max(1.0, n[bucket < 0].sum() / BUCKETS)
    level = np.zeros(BUCKETS, np.int8)
    level[bucket[bucket >= 0]] = np.log2(np.maximum(1, n[bucket >= 0] / mean)).astype(np.int8)
    return level


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) of each row with an id: component is the smallest id reachable by links of texts whose sets of shingles have Jaccard similarity `similarity` or more.

    Sets whose SimHash fingerprints (of the shingles, repeats included) are DISTANCE bits apart at most, found by multi-index hashing
    (simhash.fingerprint_links), are candidates; those that the whole sets confirm are linked. Fingerprints of sets of just that similarity
    differ in some 9 of 64 bits, so an exact way for the rest follows, between sets not connected yet.

    Two sets that similar share one of the first n - ceil(similarity * n) + 1 shingles of each, in any order that is the same
    for all; here rare ones come first. Equal sets are one node. Of the sets that share a key the one with the least digest
    is compared with all others, so a group of copies is a star and not all pairs; only for keys whose sets these links leave
    in different components the sets outside the largest one are compared with others of its sets, in ROUNDS rounds, and then with all, the largest component's sets not with each other. A pair whose sketches differ in more bits than
    the sets may differ in shingles, or that shares fewer keys than it must, is left out, which loses none; every other one is verified on the whole sets. Rows with equal ids are one node.
    """
    bound_batches(docs.sparkSession)
    share = Fraction(str(similarity))
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    level = known.sparkSession.sparkContext.broadcast(_levels(known, shingle))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds, ns, sketches, heads, fps = [], [], [], [], []
            for text in batch.column(1):
                h = list(shingle_hashes(text.as_py(), shingle))
                g = np.unique(np.concatenate([np.array([], np.uint64), *h]))
                fps.append(fingerprint_of(h))
                keep = len(g) - -(-share.numerator * len(g) // share.denominator) + 1 if len(g) else 0
                by = np.argsort(level.value[(g & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")
                ds.append(_digest(g))
                ns.append(len(g))
                heads.append(g[by[:keep]].view(np.int64))
                flips = np.bincount((g >> np.uint64(32)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
                sketches.append(np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8"))
            s = np.array(sketches, np.int64).reshape(-1, len(_LONGS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ds, pa.int64()), pa.array(ns, pa.int64()), *[pa.array(s[:, i]) for i in range(len(_LONGS))], pa.array(fps, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], ["id", "d", "n", *_LONGS, "fp", "head"])

    kind = known.schema["id"].dataType.simpleString()
    prints = stage(known.mapInArrow(first, f"id {kind}, d long, n long, {', '.join(f'{s} long' for s in _LONGS)}, fp long, head array<long>"), "shingles")
    sets = prints.select("d", "n", *_LONGS).dropDuplicates(["d"])
    filed = prints.groupBy("d").agg(F.first("head").alias("head")).select("d", F.explode("head").alias("key"))
    keys = filed.groupBy("key").agg(F.count("*").alias("m"), F.min("d").alias("hub")).where("m > 1").select("key", "hub")
    members = stage(filed.join(keys, "key"), "members")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [shingles(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(g) for g in all_], pa.int64()), pa.array([g.tobytes() for g in all_], pa.binary())], ["d", "grams"])

    @F.pandas_udf("boolean")
    def alike(x, y):
        def test(a: np.ndarray, b: np.ndarray) -> bool:
            both = len(a) + len(b) - len(np.union1d(a, b))
            return both * share.denominator >= share.numerator * (len(a) + len(b) - both)

        return pd.Series([test(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(x, y)], dtype=bool)

    def close():
        """Whether the sizes and sketches of a and b leave the pair possible."""
        differ = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in _LONGS), F.lit(0))
        lo, hi = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
        p, q = share.numerator, share.denominator
        return (lo * q >= hi * p) & (differ * (q + p) <= (q - p) * (lo + hi))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stage(pairs, name)
        wanted = pairs.select(F.col("a").alias("d")).union(pairs.select(F.col("b").alias("d"))).distinct()
        ids = prints.join(wanted, "d", "left_semi").groupBy("d").agg(F.min("id").alias("id")).select("id").distinct()
        texts = known.join(ids, "id", "left_semi").mapInArrow(grams, "d long, grams binary").dropDuplicates(["d"])
        texts = stage(texts, "grams")
        side = lambda d, g: texts.select(F.col("d").alias(d), F.col("grams").alias(g))
        found = stage(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(alike("x", "y")).select("a", "b"), "links")
        unstage(pairs, texts)
        return found

    def alike_of(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that the whole sets confirm."""
        x, y = sets.alias("x"), sets.alias("y")
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return verified(pairs.join(x, F.col("a") == F.col("x.d")).join(y, F.col("b") == F.col("y.d")).where(close()).select("a", "b"), name)

    def open_sets(parts: DataFrame) -> DataFrame:
        """(key, d, c, major) of the keys whose sets are in several components, major being the one with most of them."""
        named = members.select("key", "d").join(parts, F.col("d") == F.col("node"), "left").select("key", "d", F.coalesce("component", "d").alias("c"))
        sizes = named.groupBy("key", "c").agg(F.count("*").alias("m"))
        open_ = sizes.groupBy("key").agg(F.max_by("c", "m").alias("major"), F.count("*").alias("parts")).where("parts > 1").select("key", "major")
        return stage(named.join(open_, "key"), "open")

    marks = prints.select("fp", "d").distinct()
    reps = stage(marks.groupBy("fp").agg(F.min("d").alias("rep")), "reps")
    links = alike_of(fingerprint_links(reps, DISTANCE).union(marks.join(reps, "fp").select("d", "rep")), "candidates")
    unstage(reps)
    parts = stage(connected_components(links), "parts")
    of = lambda side: parts.select(F.col("node").alias(f"{side}_node"), F.col("component").alias(f"{side}_part"))
    spokes = members.where("d <> hub").select(F.col("hub").alias("a"), F.col("d").alias("b")).distinct()
    spokes = spokes.join(of("a"), F.col("a") == F.col("a_node"), "left").join(of("b"), F.col("b") == F.col("b_node"), "left")
    spokes = spokes.where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")
    links = links.union(alike_of(spokes, "spokes"))
    for i in range(ROUNDS + 1):
        unstage(parts)
        parts = stage(connected_components(links), "parts")
        left = open_sets(parts)
        if i == ROUNDS:
            break
        hubs = left.where("c = major").groupBy("key").agg(F.min_by("d", F.xxhash64("d", F.lit(i))).alias("a"))
        links = links.union(alike_of(left.where("c <> major").join(hubs, "key").select("a", F.col("d").alias("b")), "spokes"))
        unstage(left)
    named, left = left, stage(left.join(sets, "d"), "open")
    unstage(named)
    x, y = left.where("c <> major").alias("x"), left.alias("y")
    # A pair of smaller components is met from both sides: once is enough. The major one's sets are met from the others' side only.
    once = (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.major")) | (F.col("x.d") < F.col("y.d")))
    pairs = x.join(y, F.col("x.key") == F.col("y.key")).where(once & close())
    pairs = pairs.groupBy(F.least("x.d", "y.d").alias("a"), F.greatest("x.d", "y.d").alias("b")).agg(F.count("*").alias("m"), F.first(F.col("x.n") + F.col("y.n")).alias("n"), F.first(F.greatest("x.n", "y.n")).alias("hi"))
    # Of the set whose first shingles end earlier, what is shared is among the first ones of both or in its rest, of ceil(similarity * n) - 1.
    p, q = share.numerator, share.denominator
    pairs = pairs.where((F.col("m") - 1 + F.ceil(F.col("hi") * p / q)) * (p + q) >= p * F.col("n")).select("a", "b")
    more = verified(pairs, "pairs")
    unstage(left, members, parts)
    links = links.union(more)
    again = prints.groupBy("id").agg(F.min("d").alias("a"), F.max("d").alias("z")).where("a <> z").select("id", "a")
    links = links.union(prints.join(again, "id").where("d <> a").select("a", F.col("d").alias("b")))
    parts = connected_components(links)
    whole = stage(prints.select("id", "d").join(parts, F.col("d") == F.col("node"), "left").select("id", F.coalesce("component", "d").alias("c")), "named")
    unstage(prints)
    return whole.join(whole.groupBy("c").agg(F.min("id").alias("component")), "c").select("id", "component")


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keeps one document of each component, the one with the smallest id; of rows that repeat it, one. Rows with a null id are kept.

    Null and empty texts have no shingles, so their sets are equal and they are copies of each other. An empty table gives an empty one.
    """
    parts = near_components(docs, id_col, text_col, shingle, similarity)
    name = fresh("_keep", docs)
    keep = parts.where("id = component").select(F.col("id").alias(name)).distinct()
    kept = docs.join(keep, docs[id_col] == F.col(name), "left_semi")
    return kept.dropDuplicates([id_col]).unionByName(docs.where(docs[id_col].isNull()))
