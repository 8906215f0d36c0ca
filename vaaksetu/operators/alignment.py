"""Word alignment with its backtrace."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("ref_pos", T.IntegerType()), T.StructField("hyp_pos", T.IntegerType())]))


def edit_table(costs: np.ndarray) -> np.ndarray:
    """Table of distances, row by row: costs[i, j] is what it takes to put word j of the hypothesis for word i of the reference, 0 or 1.

    Within a row a cell follows from its left neighbour by an insertion; as that adds one a place, all of them are a running minimum of the cells less their place.
    """
    m, n = costs.shape
    place = np.arange(n + 1, dtype=np.int32)
    table = np.empty((m + 1, n + 1), np.int32)
    table[0] = place
    for i in range(m):
        row = table[i] + 1
        np.minimum(row[1:], table[i, :-1] + costs[i], out=row[1:])
        table[i + 1] = np.minimum.accumulate(row - place) + place
    return table


def align_words(ref: Sequence[str], hyp: Sequence[str]) -> list[tuple[str, int | None, int | None]]:
    """Unit-cost alignment as M, S, D and I steps; of equally cheap steps a diagonal one is taken first, then D, then I."""
    i, j, steps = len(ref), len(hyp), []
    # Where both end alike a match is the first choice, so the common end needs no table.
    while i and j and ref[i - 1] == hyp[j - 1]:
        i, j = i - 1, j - 1
        steps.append(("M", i, j))
    code: dict[str, int] = {}
    a, b = (np.fromiter((code.setdefault(w, len(code)) for w in words), np.int32, n) for words, n in ((ref[:i], i), (hyp[:j], j)))
    table = edit_table(a[:, None] != b[None, :])
    while i or j:
        here = table[i, j]
        same = i > 0 and j > 0 and a[i - 1] == b[j - 1]
        if i and j and here == table[i - 1, j - 1] + (not same):
            i, j = i - 1, j - 1
            steps.append(("M" if same else "S", i, j))
        elif i and here == table[i - 1, j] + 1:
            i -= 1
            steps.append(("D", i, None))
        else:
            j -= 1
            steps.append(("I", None, j))
    return steps[::-1]


def _alike(ref: np.ndarray, hyp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alignments of many short pairs at once, all of the same lengths: kind, ref_pos and hyp_pos of the steps, last first, padded with kind -1.

    ref, hyp: words as numbers, a pair a row. The same table and choices as align_words, cell by cell for all pairs.
    """
    (rows, m), n = ref.shape, hyp.shape[1]
    table = np.empty((m + 1, n + 1, rows), np.int32)
    table[0], table[:, 0] = np.arange(n + 1)[:, None], np.arange(m + 1)[:, None]
    for i in range(m):
        for j in range(n):
            table[i + 1, j + 1] = np.minimum(np.minimum(table[i, j + 1], table[i + 1, j]) + 1, table[i, j] + (ref[:, i] != hyp[:, j]))
    kind, at_ref, at_hyp = (np.full((rows, m + n), -1, np.int32) for _ in range(3))
    i, j, all_rows = np.full(rows, m), np.full(rows, n), np.arange(rows)
    for step in range(m + n):
        here, up, left = table[i, j, all_rows], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        both = (i > 0) & (j > 0)
        same = both & (ref[all_rows, up] == hyp[all_rows, left] if m and n else False)
        diagonal = both & (here == table[up, left, all_rows] + ~same)
        down = ~diagonal & (i > 0) & (here == table[up, j, all_rows] + 1)
        insert = ~diagonal & ~down & (j > 0)
        kind[:, step] = np.select([diagonal & same, diagonal, down, insert], [0, 1, 2, 3], -1)
        i, j = i - (diagonal | down), j - (diagonal | insert)
        at_ref[:, step], at_hyp[:, step] = np.where(diagonal | down, i, -1), np.where(diagonal | insert, j, -1)
    return kind, at_ref, at_hyp


#: Pairs are aligned together where their lengths' product is no larger.
SHORT = 64
_NAMES = pa.array(["M", "S", "D", "I"])
_KIND = {"M": 0, "S": 1, "D": 2, "I": 3}


def _steps(refs: pa.ListArray, hyps: pa.ListArray) -> pa.ListArray:
    """Alignments of a batch, made as flat arrays: a Python object a step would take a hundred times the memory."""
    count = len(refs)
    words = pa.concat_arrays([refs.flatten(), hyps.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int32)
    na, nb = (np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64) for x in (refs, hyps))
    null = refs.is_null().to_numpy(zero_copy_only=False) | hyps.is_null().to_numpy(zero_copy_only=False)
    ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
    a, b = words[: ends_a[-1] if count else 0], words[ends_a[-1] if count else 0 :]
    found: list[tuple[np.ndarray, ...] | None] = [None] * count
    lengths = na * (1 << 32) + nb
    lengths[null | (na * nb > SHORT) | (na + nb > SHORT)] = -1
    for key in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == key)
        m, n = int(na[rows[0]]), int(nb[rows[0]])
        got = _alike(a[(ends_a[rows] - m)[:, None] + np.arange(m)], b[(ends_b[rows] - n)[:, None] + np.arange(n)])
        kept = (got[0] >= 0).sum(axis=1)
        for r, row in enumerate(rows):
            found[row] = tuple(x[r, : kept[r]][::-1] for x in got)
    for row in np.flatnonzero((lengths < 0) & ~null):
        steps = align_words(a[ends_a[row] - na[row] : ends_a[row]].tolist(), b[ends_b[row] - nb[row] : ends_b[row]].tolist())
        found[row] = tuple(np.array(x, np.int32) for x in zip(*((_KIND[o], -1 if i is None else i, -1 if j is None else j) for o, i, j in steps)))
    sizes = np.array([len(f[0]) if f else 0 for f in found], np.int64)
    kind, at_ref, at_hyp = (np.concatenate([np.empty(0, np.int32), *[f[k] for f in found if f]]) for k in range(3))
    steps = pa.StructArray.from_arrays([_NAMES.take(pa.array(kind)), pa.array(at_ref, mask=at_ref < 0), pa.array(at_hyp, mask=at_hyp < 0)], names=["op", "ref_pos", "hyp_pos"])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), steps)


#: Rows that are aligned and returned together.
ROWS = 4000


@F.arrow_udf(OPS)
def align(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Alignment of two arrays of words, as an array of structs. Spark has no backtrace, so this runs in Arrow batches; use it on utterances, not documents."""
    for refs, hyps in batches:
        for i in range(0, len(refs), ROWS):
            yield _steps(refs.slice(i, ROWS), hyps.slice(i, ROWS))
