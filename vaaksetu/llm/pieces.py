"""SentencePiece encoding and decoding on the tokenizers library, rebuilt from the model's protobuf."""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Piece types and model types of the protobuf, fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters encoded at a time: bounds a task's memory whatever the texts' lengths. A longer text is a batch of its own.
BATCH_CHARS = 1 << 19
#: Distinct spans that a worker remembers; those not met lately go when it is full, which changes no result.
REMEMBER = 600_000
#: New spans that are encoded in a row.
JOIN = 200


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire in (1, 2, 5):
            n = {1: 8, 5: 4}.get(wire) or varint()
            yield number, data[i : i + n]
            i += n
        else:
            raise ValueError(f"wire type {wire}")


def parse_model(data: bytes) -> dict:
    """Pieces as (text, score, type), the model type, and the normaliser's settings."""
    model = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "trim": True, "escape": True, "suffix": False}
    for number, value in fields(data):
        if number == 1:
            f = dict(fields(value))
            model["pieces"].append((f[1].decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
        elif number == 2:
            f = dict(fields(value))
            model |= {"type": f.get(3, UNIGRAM), "byte_fallback": bool(f.get(35, 0)), "suffix": bool(f.get(24, 0))}
        elif number == 3:
            f = dict(fields(value))
            model |= {"charsmap": f.get(2, b""), "dummy_prefix": bool(f.get(3, 1)), "trim": bool(f.get(4, 1)), "escape": bool(f.get(5, 1))}
    return model


def build(data: bytes):
    """A tokenizers.Tokenizer that encodes and decodes as the model does.

    Normaliser: the model's character map, white-space trimming if it has that, the dummy prefix, spaces as
    the metaspace mark. A unigram model takes pieces with their scores. A BPE model's scores order merges, so summing
    them would give other pieces; its merges are rebuilt from the scores. Unknown characters become byte pieces where
    the model has them. Where no piece has a mark after another character, text is cut before each run of marks,
    which changes no piece and lets the library encode and remember short spans.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse_model(data)
    pieces = m["pieces"]
    ids = {p: i for i, (p, _, _) in enumerate(pieces)}
    unknown = next(i for i, x in enumerate(pieces) if x[2] == UNKNOWN)
    if m["suffix"]:
        raise ValueError("white space as a suffix isn't supported")
    if m["type"] == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unknown, byte_fallback=m["byte_fallback"])
    elif m["type"] == BPE:
        usable = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
        merges = []
        for p, s in usable.items():
            parts = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            merges += [(-s, ids[p], ids[a], ids[b], a, b) for a, b in parts]
        model = models.BPE(ids, [(a, b) for *_, a, b in sorted(merges)], unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=m["byte_fallback"])
    else:
        raise ValueError(f"model type {m['type']}")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["trim"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m["dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    if m["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (NORMAL, USER)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else [])])
    controls = [p for p, _, kind in pieces if kind == CONTROL]
    t.add_special_tokens([AddedToken(p, normalized=False, special=True) for p in controls])
    t.encode_special_tokens = True  # control strings within a text are ordinary text
    return t


class Pieces:
    """Encodes and decodes texts with the rebuilt tokenizer, each distinct span of white space and word once.

    Where text is cut before each run of marks, no piece reaches over a cut and no byte sequence does, so a text's pieces
    and its decoding are those of its spans in a row. A batch is cut, and its spans are numbered and replaced by their pieces, in
    Arrow. New spans go through the library together, those with one mark in rows of JOIN: in such a row just the first piece of
    a span begins with a mark, which tells where its pieces end. Other models, and those that leave spaces as they are, get whole texts.
    """

    def __init__(self, data: bytes, remember: int = REMEMBER):
        self.remember = remember
        self.whole = build(data)
        m = parse_model(data)
        self.simple = m["dummy_prefix"] and m["escape"] and not m["trim"] and not m["charsmap"]
        #: Piece ids of a span as bytes of int32; and the decoding of spans that don't decode to themselves.
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}
        #: What was known before half of `remember` was new.
        self.former: tuple[dict[str, bytes], dict[str, str]] = {}, {}
        self.spans = None
        if self.whole.pre_tokenizer is not None and m["escape"]:
            from tokenizers import Tokenizer, decoders, pre_tokenizers

            # No normaliser, as spans are normalised; the model itself is shared.
            self.spans, self.rows = Tokenizer(self.whole.model), Tokenizer(self.whole.model)
            self.rows.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
            self.dropped = m["dummy_prefix"]
            # As the whole model's, but marks are replaced in the fused text. Encoding has a piece for the mark, so no bytes make one.
            self.spans.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *([decoders.Strip(" ", 1, 0)] if self.dropped else [])])
            self.marked = np.array([piece.startswith(MARK) for piece, _, _ in m["pieces"]])

    def normalize(self, text: str) -> str:
        if not text:
            return ""
        return (" " + text).replace(" ", MARK) if self.simple else self.whole.normalizer.normalize_str(text)

    def _learn(self, new: list[str]) -> None:
        plain = [s for s in new if s[0] == MARK and s[1:2] not in ("", MARK)]
        single = [s for s in new if s[0] != MARK or s[1:2] in ("", MARK)]
        groups = [plain[i : i + JOIN] for i in range(0, len(plain), JOIN)]
        rows = ["".join(g) for g in groups]
        got = [e.ids for e in self.rows.encode_batch_fast(rows, add_special_tokens=False)]
        for group, row, ids, text in zip(groups, rows, got, self._decode(got)):
            ids = np.array(ids, np.int32)
            starts = np.flatnonzero(self.marked[ids])
            # A decoded span has a space at its beginning alone, so rows that agree agree in each span.
            if len(starts) != len(group) or text != row.replace(MARK, " "):
                single += group
                continue
            data, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            self.known.update((s, data[i:j]) for s, i, j in zip(group, at, at[1:]))
        got = [e.ids for e in self.spans.encode_batch_fast(single, add_special_tokens=False)]
        for s, ids, text in zip(single, got, self._decode(got)):
            self.known[s] = array("i", ids).tobytes()
            if text != s.replace(MARK, " "):
                self.odd[s] = text

    def _decode(self, ids: list[list[int]]) -> list[str]:
        # A mark before the ids stands in for the first one of a text, which decoding drops.
        lead = self.spans.token_to_id(MARK)
        return self.spans.decode_batch([[lead, *x] for x in ids] if self.dropped else ids, skip_special_tokens=False)

    def _recall(self, spans: list[str]) -> list[bytes]:
        """The spans' piece ids: those known, those known before, and new ones from the library."""
        if len(self.known) > self.remember // 2:
            self.former, self.known, self.odd = (self.known, self.odd), {}, {}
        (known, odd), new = self.former, []
        for s in [s for s in spans if s not in self.known]:
            if s in known:
                self.known[s] = known[s]
                if s in odd:
                    self.odd[s] = odd[s]
            elif s:
                new.append(s)
            else:
                self.known[s] = b""
        if new:
            self._learn(new)
        return list(map(self.known.__getitem__, spans))

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Piece ids of each text, and what they decode to."""
        ids, back = [], []
        for some in batches_of(texts):
            if self.spans is None:
                got = [e.ids for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]
                ids += [np.array(x, np.int32) for x in got]
                back += self.whole.decode_batch(got, skip_special_tokens=False)
                continue
            norm = [self.normalize(t) for t in some]
            # A normalised text has no space, so one before each run of marks tells where to cut.
            cut = pc.split_pattern(pa.array([t.replace(MARK, " " + MARK).replace(MARK + " ", MARK).removeprefix(" ") for t in norm], pa.large_string()), " ")
            coded = cut.values.dictionary_encode()
            spans = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = self._recall(spans)
            ends = np.cumsum([0, *map(len, found)])
            got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(found))]).take(coded.indices)
            _, ends, data = got.buffers()
            at = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()] // 4
            data = np.frombuffer(data, np.int32, at[-1]) if at[-1] else np.empty(0, np.int32)
            ids += [data[i:j] for i, j in zip(at, at[1:])]
            if not self.odd.keys().isdisjoint(spans):
                norm = ["".join([self.odd.get(s, s) for s in x.as_py()]) for x in cut]
            back += [t.replace(MARK, " ")[self.dropped :] for t in norm]
        return ids, back


@lru_cache(maxsize=1)
def loaded(data: bytes, remember: int = REMEMBER) -> Pieces:
    """Pieces of a model, once in a worker: its later tasks find the model built and spans known."""
    return Pieces(data, remember)


def batches_of(texts: Iterable[str]) -> Iterator[list[str]]:
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > BATCH_CHARS:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def encode_pieces(docs: DataFrame, text_col: str = "text", model: str = MODEL, verify: bool = False, remember: int = REMEMBER) -> DataFrame:
    """docs with piece_ids array<int> of the whole text, decoded (whether decoding them gives the text back) and,
    if `verify`, parity (whether the sentencepiece library gives the same ids for the whole text); columns with these names are replaced.

    Null and empty texts have no pieces and decode to the empty text. Batches are encoded in the task's own thread and
    handed on in parts of BATCH_CHARS, so memory is bounded whatever Spark's batches hold.
    `remember` bounds the distinct spans that a worker keeps, which changes its time and memory, no result. Null ids and repeated rows pass through; an empty table gives an empty one.
    The model's bytes, a fixed-size file, are read once on the driver, at a path that is a parameter.
    """
    with open(model, "rb") as f:
        data = f.read()
    added = {"piece_ids": pa.list_(pa.int32()), "decoded": pa.bool_(), **({"parity": pa.bool_()} if verify else {})}
    docs = docs.drop(*[c for c in added if c != text_col])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks keep the cores busy
        pieces, same = loaded(data, remember), None
        if verify:
            import sentencepiece

            same = sentencepiece.SentencePieceProcessor(model_proto=data)
        for batch in batches:
            at, column = 0, batch.column(batch.schema.get_field_index(text_col))
            for texts in batches_of(t.as_py() or "" for t in column):
                got, back = pieces(texts)
                new = [
                    pa.ListArray.from_arrays(np.cumsum([0, *map(len, got)]).astype(np.int32), np.concatenate(got)),
                    pa.array([a == b for a, b in zip(back, texts)]),
                ]
                if same:
                    new.append(pa.array([np.array_equal(a, b) for a, b in zip(same.encode(texts, out_type="numpy", num_threads=1), got)]))
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *added])

    schema = T.StructType(docs.schema.fields + [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), *[T.StructField(c, T.BooleanType()) for c in list(added)[1:]]])
    return docs.mapInArrow(encode, schema)


def decode_pieces(df: DataFrame, ids_col: str = "piece_ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """df with the text of its piece ids; null ids give null."""
    with open(model, "rb") as f:
        data = f.read()

    @F.pandas_udf("string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = build(data)
        for series in batches:
            yield pd.Series([None if x is None else t.decode([int(i) for i in x], skip_special_tokens=False) for x in series])

    return df.withColumn(text_col, udf(F.col(ids_col)))
