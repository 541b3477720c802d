"""Encoding against a plain Viterbi and against the sentencepiece library,
decoding as an exact round trip."""
import random
import struct

import numpy as np
import pytest

from quarry.llm import unigram


def pieces_of(words, kinds=None):
    head = [("<unk>", 0.0, "other"), ("<s>", 0.0, "other")] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    return head + [(w, s, "piece") for w, s in words]


RNG = random.Random(3)
LETTERS = "abcdé日"
WORDS = sorted({"".join(RNG.choice(LETTERS) for _ in range(RNG.randint(1, 5))) for _ in range(150)} - {"d"})
PIECES = pieces_of([(w, -RNG.uniform(2, 9)) for w in WORDS]
                   + [("▁" + w, -RNG.uniform(2, 9)) for w in WORDS[::2]] + [("▁", -4.0), ("▁▁", -5.0)])
MODEL = unigram.build(PIECES)


def slow_encode(text, pieces):
    index = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind == "piece"}
    unknown = min(s for s in (s for _, s in index.values())) - 10
    form = "▁" + text.replace("▁", "").replace(" ", "▁")
    best = [(0.0, None, None)] + [(-1e300, None, None)] * len(form)
    for i in range(len(form)):
        for j in range(i + 1, len(form) + 1):
            i_s = index.get(form[i:j]) or ((-1, unknown) if j == i + 1 else None)
            if i_s and best[i][0] + i_s[1] > best[j][0]:
                best[j] = (best[i][0] + i_s[1], i, i_s[0])
    out, at = [], len(form)
    while at:
        _, i, p = best[at]
        out[:0] = [p] if p >= 0 else [b + 2 for b in form[i:at].replace("", "▁").encode()]
        at = i
    return out


TEXTS = ["", " ", "a", "abcd", "  abc  d\n x", "日本 é▁z ▁ d", "\tdé", "d" * 50, "😀 a😀"] + [
    "".join(RNG.choice(LETTERS + " xy\n▁") for _ in range(RNG.randint(1, 60))) for _ in range(150)]


def test_encode_is_the_best_segmentation():
    got = unigram.Encoder(MODEL).encode([t.encode() for t in TEXTS])
    for text, ids in zip(TEXTS, got, strict=True):
        assert ids.tolist() == (slow_encode(text, PIECES) if text else [])
        assert unigram.decode_ids(MODEL, ids.tolist()).decode() == text


def test_small_blocks_and_forgetting_give_the_same(monkeypatch):
    want = [x.tolist() for x in unigram.Encoder(MODEL).encode([t.encode() for t in TEXTS])]
    for name, value in (("TOGETHER", 40), ("SEGMENTS_TOGETHER", 7), ("CACHED", 5), ("CACHED_BYTES", 3)):
        monkeypatch.setattr(unigram, name, value)
    assert [x.tolist() for x in unigram.Encoder(MODEL).encode([t.encode() for t in TEXTS])] == want


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, kind, data):
    return varint(number << 3 | kind) + (varint(len(data)) + data if kind == 2 else data)


def library_model(pieces):
    """The same pieces as a serialized unigram model."""
    import sentencepiece
    types = {"piece": 1, "byte": 6}
    out = b""
    for p, s, kind in pieces:
        t = 2 if p == "<unk>" else types.get(kind, 3)
        out += field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, varint(t)))
    out += field(2, 2, field(3, 0, varint(1)) + field(35, 0, varint(1)))
    out += field(3, 2, field(1, 2, b"identity") + field(3, 0, varint(1)) + field(4, 0, varint(0)) + field(5, 0, varint(1)))
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_same_as_the_library():
    sp = library_model(PIECES)
    texts = [t for t in TEXTS if t and "▁" not in t]
    got = unigram.Encoder(MODEL).encode([t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == sp.encode(text)
        assert sp.decode(ids.tolist()) == text


def test_vocabulary_file():
    model = unigram.load()
    text = "The quick brown fox\n  élan vital 日本語 😀 x=1;"
    ids = unigram.Encoder(model).encode([text.encode()])[0].tolist()
    assert unigram.decode_ids(model, ids).decode() == text
    assert len(ids) < len(text)
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=unigram.MODEL)
    assert sp.decode(ids) == text


def test_vocabularies_that_do_not_serve():
    with pytest.raises(ValueError, match="byte"):
        unigram.build([("a", -1.0, "piece")])
    with pytest.raises(ValueError, match="marker"):
        unigram.build(pieces_of([("a▁b", -1.0)]))


def test_frames(spark):
    data = [(1, "a b", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (None, "dé ▁", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, pieces string")
    rows = unigram.encode(docs, MODEL)
    got = unigram.decode(rows, MODEL).collect()
    assert sorted(((r.doc_id, r.text, r.decoded) for r in got), key=repr) == sorted(((i, t, t) for i, t, _ in data), key=repr)
    counts = {r.doc_id: (r.p, r.n) for r in rows.select("doc_id", rows.pieces.alias("p"), unigram.byte_pieces(MODEL).alias("n")).collect()}
    assert counts[2][0] is None and counts[3] == ([], 0) and counts[None][1] > 0
    assert unigram.encode(docs.limit(0), MODEL).count() == 0


def test_double_array_holds_what_was_put_in():
    words = {bytes(np.random.default_rng(i).integers(0, 256, 1 + i % 6, dtype=np.uint8)): i for i in range(500)}
    base, check, value = unigram.double_array(words)
    for word, i in words.items():
        at = 0
        for c in word:
            nxt = base[at] + c
            assert check[nxt] == at
            at = nxt
        assert value[at] == i
