"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, stage, words_of
from .graph import connected_components

#: Shingles hashed at a time, so that a very long text needs no more memory than a short one.
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = 3) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, repeats included, some at a time; a shorter text is one shingle, a text without words has none."""
    words = words_of(text)
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    lo, hi, digest = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), xxhash.xxh64_intdigest
    for i in range(0, n, _CHUNK):
        yield np.array([digest(line[s:e], 42) for s, e in zip(lo[i : i + _CHUNK], hi[i : i + _CHUNK])], dtype="<u8")


def fingerprint_of(hashes: Iterable[np.ndarray]) -> int:
    """64-bit SimHash of hashes, as a signed long: a bit is 1 if set in over half of them; zero if there are none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, as a signed long; a text without words has fingerprint zero."""
    return fingerprint_of(shingle_hashes(text, shingle))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row, whole texts; fp is the fingerprint's 64 bits as a long."""

    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def _probes(segment: int, width: int, radius: int):
    """The Hamming ball around a segment, as columns, but only the keys with more bits set than the segment has.

    Two segments that differ in one bit meet anyway: one of them lacks the bit.
    """
    seg = F.shiftrightunsigned("fp", segment * width).bitwiseAND(F.lit((1 << width) - 1))
    own = F.struct(F.lit(segment).alias("seg"), seg.alias("key"), F.lit(True).alias("own"))
    if radius == 0:
        return F.array(own)
    bits = F.array(*[F.lit(1 << i) for i in range(width)])
    up = F.transform(F.filter(bits, lambda b: seg.bitwiseAND(b) == 0), lambda b: F.struct(F.lit(segment).alias("seg"), seg.bitwiseOR(b).alias("key"), F.lit(False).alias("own")))
    return F.concat(F.array(own), up)


def _links(fps: np.ndarray, reps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among these fingerprints, as pairs of representatives."""
    rest, out = np.arange(len(fps)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[i]) <= distance
            if near.any():
                found = rest[near]
                out += [(int(reps[j]), int(reps[i])) for j in found]
                queue += found.tolist()
                rest = rest[~near]
    return out


def fingerprint_links(prints: DataFrame, distance: int = 3, block: int = 2048) -> DataFrame:
    """Edges (a, b) between representatives that join every pair of fingerprints at most `distance` bits apart.

    prints: one row per distinct fingerprint, (fp, rep). With two segments of 32 bits, a pair within
    3 bits differs by at most one bit in one of them, so each fingerprint is filed under both its
    segments and looked up under every key of the ball of radius distance // 2 around them. Keys
    without a match fall out in an equi-join on distinct keys; what is left is gathered by key into
    blocks of about `block` rows, each pair of blocks of a large key being one group, so a key that very many
    fingerprints share is spread over tasks and compared in full without listing its pairs.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be from 0 to 3")
    radius = distance // 2
    filed = prints.select("fp", "rep", F.explode(F.concat(_probes(0, 32, radius), _probes(1, 32, radius))).alias("p")).select("fp", "rep", "p.*")
    keys = filed.groupBy("seg", "key").agg(F.count("*").alias("n"), F.max("own").alias("any"))
    keys = keys.where("any and n > 1").select("seg", "key", F.ceil(F.col("n") / block).cast("int").alias("c"))
    kept = filed.join(keys.hint("merge"), ["seg", "key"])
    i = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    # Block i of a key meets every block j of it: the group of (i, j), smaller number first.
    kept = kept.withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    groups = kept.groupBy("seg", "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.collect_list(F.struct("fp", "rep")).alias("m")).where(F.size("m") > 1)

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def links(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for fps, reps in batches:
            yield pd.Series([[{"a": a, "b": b} for a, b in _links(np.asarray(f, np.int64).view(np.uint64), np.asarray(r), distance)] for f, r in zip(fps, reps)])

    return groups.select(F.explode(links(F.col("m.fp"), F.col("m.rep"))).alias("e")).select("e.a", "e.b")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: (id, fp, component), component being the smallest id reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Rows with equal ids are one
    node. Rows with a null id keep their fingerprint and get the component of documents that share it
    (null if there are none). Exact copies and texts with equal fingerprints are first gathered to one
    representative, by minima that are combined before the shuffle, so thousands of copies cost one row.
    """
    prints = stage(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    # A repeated id stands for one node even if its rows differ in text.
    again = prints.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1 and lo != hi").select("id")
    edges = fingerprint_links(reps.where("rep is not null"), distance)
    same = prints.join(again.hint("merge"), "id").join(reps.hint("merge"), "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(edges.union(same))
    named = reps.join(parts.hint("merge"), reps.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return prints.join(named.hint("merge"), "fp").select("id", "fp", "component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 3) -> DataFrame:
    """Keeps one document of each component, the one with the smallest id; of rows that repeat it, one. Columns are those of docs.

    Rows with a null id are kept: nothing says which of them a repeated row is. Null and empty texts are copies of each other; an empty table gives an empty one.
    """
    parts = simhash_components(docs, id_col, text_col, shingle, distance)
    name = fresh("_keep", docs)
    keep = parts.where("id = component").select(F.col("id").alias(name)).distinct()
    kept = docs.join(keep, docs[id_col] == F.col(name), "left_semi")
    alone = docs.where(docs[id_col].isNull())
    return kept.dropDuplicates([id_col]).unionByName(alone)
