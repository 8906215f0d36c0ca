import struct

import sentencepiece
from pyspark.sql import functions as F

from vaaksetu.llm import pieces

HARD = ["", " ", "a  b", "   x", "tail   ", "<s> x </s><unk>", "日本語 \x00 é́", "▁▁x ▁", "\n\n a\tb", "🙂🙂 <0x41>", "a" * 500, "नमस्ते ", "  ", "▁", "x\r\ny", "of the▁of", "word " * 30_000]


def test_parity_and_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(HARD + [None])], "doc_id long, text string, parity string")
    out = {r.doc_id: r for r in pieces.encode_pieces(docs, verify=True).collect()}
    same = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for i, t in enumerate(HARD):
        assert out[i].piece_ids == same.encode(t) and out[i].parity
        assert out[i].decoded == (same.decode(out[i].piece_ids) == t)
    assert out[len(HARD)].piece_ids == []
    back = pieces.decode_pieces(pieces.encode_pieces(docs).drop("text")).orderBy("doc_id").collect()
    assert [r.text for r in back][:-1] == [same.decode(same.encode(t)) for t in HARD]
    assert pieces.encode_pieces(docs.where("false")).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = pieces.encode_pieces(docs, verify=True)
    assert out.where(~F.col("parity") | ~F.col("decoded")).count() == 0


def test_rows_of_spans_and_a_small_memory(monkeypatch):
    """Spans learned in short rows, by a worker that forgets often, give the pieces of whole texts."""
    monkeypatch.setattr(pieces, "JOIN", 3)
    monkeypatch.setattr(pieces, "REMEMBER", 5)
    monkeypatch.setattr(pieces, "BATCH_CHARS", 40)
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    same = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = HARD + [f"w{i} ▁v{i * 7}  é{i}\t🙂{i} " for i in range(200)]
    ids, back = pieces.Pieces(data)(texts)
    assert [x.tolist() for x in ids] == [same.encode(t) for t in texts]
    assert back == [same.decode(x.tolist()) for x in ids]


def test_spans_met_again_stay_known():
    """A worker whose memory is full forgets spans that it no longer meets, and doesn't encode the common ones again."""
    with open(pieces.MODEL, "rb") as f:
        p = pieces.Pieces(f.read(), remember=20)
    learned, learn = [], p._learn
    p._learn = lambda new: (learned.extend(new), learn(new))
    for i in range(30):
        p([f"the a{i} b{i} c{i} of"])
    assert learned.count("▁the") == learned.count("▁of") == 1 and len(learned) == 2 + 90
    assert len(p.known) + len(p.former[0]) <= 20 + 2 * 5
    ids, back = p([""])
    assert ids[0].dtype == "int32" and ids[0].tolist() == [] and back == [""]


def field(n, wire, data):
    if wire == 2:
        return bytes([n << 3 | 2]) + bytes([len(data)]) + data
    return bytes([n << 3 | wire]) + data


def test_unigram_model():
    """A small unigram model, written field by field: the best-scoring split wins, unknown bytes fall back."""
    vocab = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", -20.0, 6) for b in range(256)], ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -4.0, 1), ("▁ab", -9.0, 1), ("▁a", -4.5, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in vocab)
    data += field(2, 2, field(3, 0, b"\x01") + bytes([35 << 3 & 127 | 128, 35 >> 4, 1])) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))
    m = pieces.parse_model(data)
    assert m["type"] == pieces.UNIGRAM and m["byte_fallback"] and len(m["pieces"]) == len(vocab)
    t = pieces.build(data)
    name = lambda text: [vocab[i][0] for i in t.encode(text, add_special_tokens=False).ids]
    score = {p: s for p, s, _ in vocab}
    # Two splits share the best score of -7; the others have -7.5 and less.
    assert "".join(name("ab")) == "▁ab" and sum(map(score.get, name("ab"))) == -7.0
    assert name("é") == ["▁", "<0xC3>", "<0xA9>"]
    assert t.decode(t.encode("é ab", add_special_tokens=False).ids, skip_special_tokens=False) == "é ab"


def test_unknown_characters_after_forgetting():
    """Without byte pieces some spans don't decode to themselves, also when they are recalled from what was known before."""
    vocab = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("▁▁", -3.5, 1), ("▁a", -2.5, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in vocab)
    data += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))
    whole, p = pieces.build(data), pieces.Pieces(data, remember=4)
    for text in ["é a", "b   aé ", "a b é", "ab ba aab", "é", "▁é▁▁a", "", "bb aa é b"] * 3:
        want = whole.encode(text, add_special_tokens=False).ids
        ids, back = p([text])
        assert ids[0].tolist() == want and back == [whole.decode(want, skip_special_tokens=False)]
