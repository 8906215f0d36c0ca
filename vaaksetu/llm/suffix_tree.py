"""Language-model scoring with a probabilistic suffix tree over tokens."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage, words_of

#: The token that ends a text. No word holds its byte.
END = b"\n"
#: Longest context in tokens.
DEPTH = 3
#: Times that a context occurs in training before it is tested, whatever the corpus.
LEAST = 8
#: Tokens and distinct tokens after which a task starts a new block.
BLOCK_TOKENS, BLOCK_WORDS = 1_000_000, 400_000
#: Training tokens for each bucket that counts are summed in.
BUCKET_TOKENS = 1_000_000
#: A context with at least this share of all training tokens, and at least HOT_LEAST of them, is hot: its next tokens are dealt over
#: all buckets. Contexts of one length don't overlap in place, so at most 1 / HOT of a length are hot, whatever the corpus.
HOT, HOT_LEAST = 1e-5, 100_000
#: Bits of a context that lead its keys, so that keys in order are in order of buckets too; and those that tell its next tokens apart.
LEAD, NEXT = 24, 40


class _Block(dict):
    """One block of texts: its tokens numbered in order of appearance."""

    def __init__(self) -> None:
        super().__init__()
        self.id, self.tokens, self.train = uuid.uuid4().int >> 65, 0, []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def add(self, text: str | None, train: bool) -> np.ndarray:
        words = words_of(text)
        words.append(END)
        codes = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        self.tokens += len(codes)
        if train:
            self.train.append(codes)
        return codes

    def counts(self) -> np.ndarray:
        return np.bincount(np.concatenate(self.train), minlength=len(self)) if self.train else np.zeros(len(self), np.int64)


def _zip(x: np.ndarray) -> bytes:
    """Integers packed small: the bytes of equal weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unzip(x: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_ENCODED = "block long, ids array<long>, held array<boolean>, sizes array<int>, codes binary, h binary, low binary, n binary, train long"


def _rows(**columns) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "codes": pa.binary(), "h": pa.binary(), "low": pa.binary(), "n": pa.binary(), "train": pa.int64()}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in kinds.items()], list(kinds))


def _encode(folds: int, fold: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as numbers within their block, some in a row, then hashes of the block's own list of tokens with their training counts."""
        block = _Block()

        def words() -> pa.RecordBatch:
            n = block.counts()
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, block)), ">u8").reshape(-1, 2).astype(np.uint64)
            low = (digest[:, 1] >> np.uint64(48)).astype(np.uint16)
            return _rows(block=[block.id], h=[digest[:, 0].tobytes()], low=[low.tobytes()], n=[_zip(n)], train=[int(n.sum())])

        def texts() -> pa.RecordBatch:
            ids, held, codes = zip(*docs)
            return _rows(block=[block.id], ids=[ids], held=[held], sizes=[[len(x) for x in codes]], codes=[_zip(np.concatenate(codes))])

        for batch in batches:
            docs: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold
                docs.append((doc_id, held, block.add(text.as_py(), not held)))
                if block.tokens >= BLOCK_TOKENS or len(block) >= BLOCK_WORDS:
                    yield texts()
                    yield words()
                    docs, block = [], _Block()
            if docs:
                yield texts()
        if block:
            yield words()

    return encode


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and where each place's value is among them."""
    order = np.argsort(x)
    x = x[order]
    edge = np.ones(len(x), bool)
    edge[1:] = x[1:] != x[:-1]
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(edge) - 1
    return x[edge], order[edge], inverse


def _deal(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its hashes in their order)."""
    order = np.argsort(h, kind="stable")
    bucket = ((h[order] >> np.uint64(64 - LEAD)) * np.uint64(buckets) >> np.uint64(LEAD)).astype(np.int64)
    found, first = np.unique(bucket, return_index=True)
    return zip(found.tolist(), np.split(order, first[1:]))


def _ask_words(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's tokens by bucket: hashes as differences, the bits that they have beyond 64, training counts."""
        for batch in batches:
            for block, h, low, n in zip(*(x.to_pylist() for x in batch.columns)):
                h, low, n = np.frombuffer(h, np.uint64), np.frombuffer(low, np.uint16), _unzip(n, np.int64)
                rows = [(block, bucket, _zip(np.diff(h[at], prepend=np.uint64(0))), _zip(low[at]), _zip(n[at])) for bucket, at in _deal(h, buckets)]
                types = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["block", "bucket", "h", "low", "n"])

    return ask


def _sum_words(table: pa.Table) -> pa.Table:
    """Counts of a bucket's tokens over all blocks, in the order of each block's question, then how many tokens have been seen, and once."""
    numbers = lambda name, kind: [_unzip(x.as_py(), kind) for x in table.column(name)]
    h = [np.cumsum(x, dtype=np.uint64) for x in numbers("h", np.uint64)]
    ends = np.cumsum([len(x) for x in h])
    h, low = np.concatenate(h), np.concatenate(numbers("low", np.uint16))
    order = np.lexsort((low, h))
    h, low = h[order], low[order]
    edge = np.ones(len(h), bool)
    edge[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(edge) - 1
    count = np.bincount(of, np.concatenate(numbers("n", np.int64))).astype(np.int64)
    given, bucket = count[of], table.column("bucket")[0].as_py()
    rows = [(block, bucket, _zip(x), None, None) for block, x in zip(table.column("block").to_pylist(), np.split(given, ends[:-1]))]
    rows.append((None, bucket, None, int((count > 0).sum()), int((count == 1).sum())))
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["block", "bucket", "a", "kinds", "once"])


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ b * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def _earlier(f: np.ndarray, k: int) -> np.ndarray:
    """The value k places earlier, 0 where there is none."""
    out = np.zeros_like(f)
    if k < len(f):
        out[k:] = f[:-k]
    return out


#: What a block asks a bucket: contexts with the number of their keys and how often their suffix occurs; keys (next tokens) with their counts
#: after the suffix and in the block's training texts. All are whole numbers, so sums don't depend on the order in which blocks come.
_ASKED = "block long, depth int, bucket int, hot boolean, contexts binary, runs binary, totals binary, keys binary, ups binary, n binary"
#: The answer, in the order of the question: counts of keys; kinds of next tokens of contexts, 0 if not retained. Or, for hot contexts, the
#: bucket's part of their kinds, of how often they occur, and of their gain.
_ANSWERED = "block long, depth int, bucket int, hot boolean, a binary, b binary, hot_context long, hot_kinds long, hot_times long, hot_part double"


class _Path:
    """The contexts at each place of a block's texts, from the root on, a token longer at each step.

    A context is known by a hash of 64 bits, its next tokens by NEXT bits each. It is counted if it occurs LEAST times in training, its suffix is retained and,
    beyond one token, what precedes its last token is counted; so how often it occurs is always known already from the step before.
    """

    def __init__(self, code: np.ndarray, sizes: np.ndarray, train: np.ndarray, h: np.ndarray, c: np.ndarray, total: int, buckets: int, least: int):
        self.sizes = sizes
        self.h, self.count = h[code], c[code]
        self.place = np.arange(len(code)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.train = np.repeat(train, self.sizes)
        self.context, self.total = np.zeros(len(code), np.uint64), np.full(len(code), total, np.int64)
        self.retained, self.buckets, self.least, self.depth = np.ones(len(code), bool), buckets, least, 0
        self.hot = max(HOT * total, HOT_LEAST)

    def grow(self) -> None:
        """Contexts longer by a token, and their keys in the order of buckets and contexts, the same in each round."""
        self.depth += 1
        ok = self.retained & (self.place >= self.depth)
        total = np.where(ok, _earlier(self.count, 1), 0)
        self.at = at = np.flatnonzero(total >= self.least)
        self.context = _mix(self.context, _earlier(self.h, self.depth))
        mixed = _mix(self.context[at], self.h[at])
        low = np.uint64((1 << NEXT) - 1)
        key, first, inverse = _distinct(self.context[at] & ~low | mixed >> np.uint64(LEAD))
        one, n = at[first], np.bincount(inverse, self.train[at], len(key)).astype(np.int64)
        context, times, buckets = self.context[one], total[one], np.uint64(self.buckets)
        # Keys are in the order of the buckets of their contexts already, all but those of hot contexts.
        chunk = ((key >> np.uint64(NEXT)) * buckets >> np.uint64(LEAD)).astype(np.int64)
        hot = np.flatnonzero(times >= self.hot)
        chunk[hot] = ((key[hot] & low) >> np.uint64(NEXT - LEAD)) * buckets >> np.uint64(LEAD)
        chunk[hot] += self.buckets
        by = np.concatenate([np.flatnonzero(times < self.hot), hot[np.lexsort((context[hot], chunk[hot]))]])
        self.n, self.chunk, context, one = n[by], chunk[by], context[by], one[by]
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.sorted = place[inverse]
        self.key, self.up = self.h[one] >> np.uint64(64 - NEXT), self.count[one]
        edge = np.ones(len(by), bool)
        edge[1:] = (context[1:] != context[:-1]) | (self.chunk[1:] != self.chunk[:-1])
        self.start = np.flatnonzero(edge)
        self.contexts, self.runs, self.totals = context[self.start], np.diff(np.append(self.start, len(by))), self.total[one[self.start]]
        self.total = total

    def slices(self) -> Iterator[tuple[int, slice, slice]]:
        """(chunk, its keys, its contexts)."""
        chunks, first = np.unique(self.chunk, return_index=True)
        for c, lo, hi in zip(chunks.tolist(), first.tolist(), [*first.tolist()[1:], len(self.chunk)]):
            yield c, slice(lo, hi), slice(*np.searchsorted(self.start, [lo, hi]).tolist())

    def settle(self, answers: dict[int, tuple], hot: tuple) -> None:
        """Takes the answers on this length in: what is retained, and how often each key occurs."""
        n, kinds = np.zeros(len(self.key), np.int64), np.zeros(len(self.start), np.int64)
        for chunk, keys, contexts in self.slices():
            a, b = answers[chunk]
            n[keys] = _unzip(a, np.int64)
            kinds[contexts] = _unzip(b, np.int64) if chunk < self.buckets else hot[1][np.searchsorted(hot[0], self.contexts[contexts])]
        self.count, self.kinds = np.zeros_like(self.total), np.zeros_like(self.total)
        self.count[self.at], self.kinds[self.at] = n[self.sorted], np.repeat(kinds, self.runs)[self.sorted]
        self.retained = self.kinds > 0


def _retained(kinds: np.ndarray, times: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Kinds of the contexts that the divergence test keeps, 0 for the others."""
    log = np.log(np.maximum(1, times))
    return np.where(part - times * log >= kinds * log / 2, kinds, 0)


def _sum_bucket(table: pa.Table) -> pa.Table:
    """Counts of a bucket's keys over all blocks, and what the test says of its contexts, as answers to each block."""
    got = {name: table.column(name).to_pylist() for name in table.column_names}
    numbers = lambda name, kind: [_unzip(x, kind) for x in got.pop(name)]
    contexts = [np.cumsum(x, dtype=np.uint64) for x in numbers("contexts", np.uint64)]
    ends = np.cumsum([len(x) for x in contexts])
    every, at, of = _distinct(np.concatenate(contexts))
    del contexts
    totals = np.concatenate(numbers("totals", np.int64))[at]
    keys = numbers("keys", np.uint64)
    key_ends = np.cumsum([len(x) for x in keys])
    # A bucket has about BUCKET_TOKENS / LEAST contexts of one length, far fewer than 2 ** LEAD.
    pair = np.repeat(of.astype(np.uint64) << np.uint64(NEXT), np.concatenate(numbers("runs", np.int32))) | np.concatenate(keys)
    del keys
    pair, first, inverse = _distinct(pair)
    up = np.concatenate(numbers("ups", np.int64))[first]
    count = np.bincount(inverse, np.concatenate(numbers("n", np.int32)), len(pair)).astype(np.int64)
    context = (pair >> np.uint64(NEXT)).astype(np.int64)
    times, kinds = (np.bincount(context, x, len(every)).astype(np.int64) for x in (count, count > 0))
    part = np.bincount(context, count * (np.log(np.maximum(1, count)) - np.log(np.maximum(1, up)) + np.log(np.maximum(1, totals))[context]), len(every))
    kept, count, out, hot = _retained(kinds, times, part), count[inverse], [], set()
    for block, is_hot, lo, hi, i, j in zip(got["block"], got["hot"], [0, *ends[:-1]], ends, [0, *key_ends[:-1]], key_ends):
        out.append((block, got["depth"][0], got["bucket"][0], is_hot, _zip(count[i:j]), None if is_hot else _zip(kept[of[lo:hi]]), None, None, None, None))
        if is_hot:
            hot.update(of[lo:hi].tolist())
    for c in sorted(hot):
        out.append((None, got["depth"][0], None, True, None, None, int(every[c : c + 1].view(np.int64)[0]), int(kinds[c]), int(times[c]), float(part[c])))
    kinds_ = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), kinds_)], names=[x.split()[0] for x in _ANSWERED.split(", ")])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, learned from the rows that aren't held out.

    The model's symbols are the tokens seen in training and one that stands for all unseen ones. Its root gives the unseen one
    as much as tokens seen once have (Good and Turing), and shares the rest by count. A context of up to `depth` tokens that occurs
    `least` times or more is retained if its suffix is and the log-likelihood that its own distribution gains over its suffix's, n times their
    divergence, is half of log n at least for each kind of next token. Along the path from the root each retained state mixes its counts with its
    suffix's distribution by Witten and Bell's weights, so every distribution is proper and no token has probability zero.

    Texts become numbers within blocks of a few million tokens, once; a block sends hashes of its distinct tokens with their training
    counts to buckets, which sum them over all blocks and answer. Then, a context length at a time, each block
    sends its distinct (context, next token) with their counts to buckets, packed in arrays; a bucket sums them over all blocks and answers
    each block in its own order. So the tree grows with the corpus in a table that is never held by one task nor broadcast.
    Only hot contexts are, whose keys lie in all buckets and whose number has a fixed bound.

    Null and empty texts are the end token alone; a null id counts as empty text when folds are dealt; repeated rows count each
    time; an empty table has no scores. Tokens are known by hashes of 80 bits when they
    are counted, contexts of 64 and a context's next tokens of 40; two whose hashes agree would be taken for one.
    """
    spark = docs.sparkSession
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    encoded = stage(docs.select(id_, text).mapInArrow(_encode(folds, fold), _ENCODED), "encoded")
    total = encoded.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    buckets = min(1 << LEAD, max(1, -(-total // BUCKET_TOKENS)))
    asked = encoded.where("h is not null").select("block", "h", "low", "n").mapInArrow(_ask_words(buckets), "block long, bucket int, h binary, low binary, n binary")
    counted = stage(asked.groupBy("bucket").applyInArrow(_sum_words, "block long, bucket int, a binary, kinds long, once long"), "answers")
    kinds, once = counted.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("once"), F.lit(0))).first()
    unseen = min(0.5, max(once, 1) / (total + 1)) if total else 1.0
    texts = encoded.select("block", "ids", "held", "sizes", "codes", "h")
    answers = [counted.where("block is not null").select("block", F.lit(0).alias("depth"), "bucket", F.lit(False).alias("hot"), "a", F.lit(None).cast("binary").alias("b"))]
    empty = (np.array([], np.uint64), np.array([], np.int64))
    shared = []

    def path(left: pa.Table, right: pa.Table) -> tuple[_Path, np.ndarray, np.ndarray]:
        """The path up to the last length that has been answered, with each place's count and its probability so far."""
        given: dict[int, dict] = {}
        for d, bucket, hot, a, b in zip(*(right.column(x).to_pylist() for x in ("depth", "bucket", "hot", "a", "b"))):
            given.setdefault(d, {})[bucket + hot * buckets] = (a, b)
        h = np.frombuffer(next(x for x in left.column("h").to_pylist() if x is not None), np.uint64)
        c = np.zeros(len(h), np.int64)
        for bucket, at in _deal(h, buckets):
            c[at] = _unzip(given[0][bucket][0], np.int64)
        code = np.concatenate([_unzip(x, np.int32) for x in left.column("codes").to_pylist() if x is not None])
        flat = lambda name: pc.list_flatten(left.column(name)).to_numpy()
        p = _Path(code, flat("sizes").astype(np.int64), ~flat("held").astype(bool), h, c, total, buckets, least)
        seen = p.count
        prob = np.where(seen > 0, (1 - unseen) * seen / max(1, total), unseen)
        for d, hot in enumerate(shared, 1):
            p.grow()
            p.settle(given.get(d, {}), hot.value)
            prob = np.where(p.retained, (p.count + p.kinds * prob) / np.maximum(1, p.total + p.kinds), prob)
        return p, seen, prob

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        p, _, _ = path(left, right)
        p.grow()
        out, block = [], left.column("block")[0].as_py()
        for chunk, keys, contexts in p.slices():
            runs, n = (_zip(x.astype(np.int32)) for x in (p.runs[contexts], p.n[keys]))
            steps = _zip(np.diff(p.contexts[contexts], prepend=np.uint64(0)))
            out.append((block, p.depth, chunk % buckets, chunk >= buckets, steps, runs, _zip(p.totals[contexts]), _zip(p.key[keys]), _zip(p.up[keys]), n))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 6]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 10, types)], names=[x.split()[0] for x in _ASKED.split(", ")])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        p, seen, prob = path(left, right)
        sums = lambda x: np.add.reduceat(x, np.cumsum(p.sizes) - p.sizes)
        base = np.log10((seen + 1) / (total + (kinds + 1)))
        rows = (pc.list_flatten(left.column("ids")), pc.list_flatten(left.column("held")), pa.array(p.sizes, pa.int64()), pa.array(sums((seen > 0).astype(np.int64))), pa.array(np.full(len(p.sizes), total, np.int64)), pa.array(sums(base)), pa.array(sums(np.log10(prob))))
        return pa.table(list(rows), names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    by_block = lambda: texts.groupBy("block").cogroup(reduce(DataFrame.union, answers).withColumnRenamed("block", "to").groupBy("to"))
    for d in range(1, depth + 1):
        # Questions aren't staged: they are the largest table, and come out the same when a lost executor's are asked again.
        got = stage(by_block().applyInArrow(ask, _ASKED).groupBy("bucket").applyInArrow(_sum_bucket, _ANSWERED), "answers")
        hot = got.where("block is null").groupBy("hot_context").agg(F.sum("hot_kinds"), F.sum("hot_times"), F.sum("hot_part")).toPandas().to_numpy(object)
        hot = (hot[:, 0].astype(np.int64).view(np.uint64), _retained(hot[:, 1].astype(np.int64), hot[:, 2].astype(np.int64), hot[:, 3].astype(float))) if len(hot) else empty
        by = np.argsort(hot[0])
        shared = [*shared, spark.sparkContext.broadcast(tuple(x[by] for x in hot))]
        answers.append(got.where("block is not null").select("block", "depth", "bucket", "hot", "a", "b"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block().applyInArrow(score, schema)
