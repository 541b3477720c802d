"""Suffix arrays against sorting, removal against a direct computation."""
import hashlib
import random

import numpy as np
import pytest

from quarry.llm import induced, suffix_dedup
from quarry.llm.queries import op5_suffix_dedup


@pytest.mark.parametrize("kinds", [1, 2, 4, 200])
def test_suffix_array_and_prefixes(kinds):
    rng = np.random.default_rng(kinds)
    for n in [*range(1, 12), 100, 700]:
        text = np.concatenate([rng.integers(1, kinds + 1, n), [0]])
        want = sorted(range(n + 1), key=lambda i: text[i:].tolist())
        array = induced.suffix_array(text)
        assert array.tolist() == want
        prefixes = induced.common_prefixes(text.astype(np.uint8), array, np.arange(n + 1), 20)
        place = {p: i for i, p in enumerate(want)}
        for p in range(n + 1):
            q, k = want[place[p] - 1] if place[p] else n + 1, 0
            while max(p, q) + k <= n and text[p + k] == text[q + k] and k < 20:
                k += 1
            assert prefixes[p] == k


def test_short_stretches_of_the_scan(monkeypatch):
    monkeypatch.setattr(induced, "FIRST_STRETCH", 1)
    text = np.concatenate([np.random.default_rng(0).integers(1, 4, 500), [0]])
    assert induced.suffix_array(text).tolist() == sorted(range(501), key=lambda i: text[i:].tolist())


def slow_removal(rows):
    """(id, text) rows to (id, n_bytes, spans, kept)."""
    owner = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            s = data[p:p + 50]
            owner[s] = min(owner.get(s, suffix_dedup.NULL_ID), suffix_dedup.NULL_ID if i is None else i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        mine = suffix_dedup.NULL_ID if i is None else i
        gone = [False] * len(data)
        for p in range(len(data) - 49):
            if owner[data[p:p + 50]] < mine:
                gone[p:p + 50] = [True] * 50
        spans = [p for p in range(len(data) + 1) if (p < len(data) and gone[p]) != (p > 0 and gone[p - 1])]
        out.append((i, len(data), list(zip(spans[::2], spans[1::2], strict=True)), bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def planted_rows():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé \n\x00") for _ in range(n))
    shared, line = text(130), text(49)
    base = text(900)
    rows = [(7, base), (3, base), (9, base[:400] + "X" + base[401:]), (5, text(60) + shared + text(33)),
            (2, shared), (4, text(10) + shared[5:60] + text(20)), (8, line + text(40)), (1, line + "zz" + text(40)),
            (10, "a" * 500), (11, "a" * 300), (6, None), (12, ""), (13, shared[:49]), (14, shared[:50]),
            (None, shared), (None, base), (15, base), (15, base), (15, base[3:200] + "q")]
    return rows + [(100 + k, base[:k * 7] + str(k) + base[k * 7:]) for k in range(20)]


@pytest.mark.parametrize("sizes", [{}, {"PACK_BYTES": 700, "SHARD_BYTES": 2000, "SORT_BYTES": 200, "BLOCK": 64}])
@pytest.mark.parametrize("least", [1 << 14, 1, 2])
def test_removal(spark, monkeypatch, sizes, least):
    """With no, all and some minimizers cut into strings."""
    rows = planted_rows()
    if sizes:  # the kernels without workers, which would not see the patch
        for name, value in sizes.items():
            monkeypatch.setattr(suffix_dedup, name, value)
        got = without_spark(rows, least)
    else:
        monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", least)
        monkeypatch.setattr(suffix_dedup, "PACK_SHARE", 1)
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, pack string").repartition(5)
        got = [(r.id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(slow_removal(rows), key=repr)


class Held:
    def __init__(self, value):
        self.value = np.array(sorted(value), dtype=np.uint64)


def packs_of(rows, step):
    for n, at in enumerate(range(0, len(rows), step)):
        part = rows[at:at + step]
        texts = [(t or "").encode() for _, t in part]
        yield n, [i for i, _ in part], [len(t) for t in texts], suffix_dedup.zstandard.compress(b"".join(texts))


def minimizers(packs):
    """Different stretches of each minimizer."""
    found = {}
    for _, *row in packs:
        _, _, text, begin, count, key, _, _ = suffix_dedup.pack_stretches(*row)
        for b, c, k in zip(begin.tolist(), count.tolist(), key.tolist(), strict=True):
            found.setdefault(k, set()).add(text[b:b + c + 49].tobytes())
    return found


def without_spark(rows, least):
    import pyarrow as pa
    answers = {}
    packs = list(packs_of(rows, 4))
    hot = Held(k for k, v in minimizers(packs).items() if len(v) >= least)
    assert len(hot.value) or least > 2
    table = lambda p: pa.RecordBatch.from_pydict({"pack": [p[0]], "ids": [p[1]], "sizes": [p[2]], "data": [p[3]]})
    by = lambda rows, key: {k: [r for r in rows if r[key] == k] for k in {r[key] for r in rows}}
    asked = [r for p in packs for b in suffix_dedup.asking(5)(iter([table(p)])) for r in b.to_pylist()]
    told = by([r for found in by(asked, "shard").values() for r in suffix_dedup.counting(pa.Table.from_pylist(found)).to_pylist()], "pack")
    kind = pa.schema([("pack", pa.int64()), ("shard", pa.int64()), ("shared", pa.binary())])
    sent = [r for p in packs for r in suffix_dedup.sending(7, 5, hot)(
        pa.Table.from_batches([table(p)]), pa.Table.from_pylist(told.get(p[0], []), kind)).to_pylist()]
    shards = by(sent, "shard")
    for found in shards.values():
        for r in suffix_dedup.resolving(pa.Table.from_pylist(found)).to_pylist():
            answers.setdefault(r["pack"], []).append(r)
    out = []
    for p in packs:
        got = suffix_dedup.removing(hot)(pa.Table.from_batches([table(p)]), pa.Table.from_pylist(
            answers.get(p[0], []), pa.schema([("pack", pa.int64()), ("answers", pa.binary())])))
        out += [(r["id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"]) for r in got.to_pylist()]
    return out


def boilerplate_rows():
    """One line of 41 bytes in every document, with other neighbours; some of the
    neighbours are the same in a few documents."""
    rng = random.Random(9)
    line = "All rights reserved by the owners (2024)."
    assert len(line) == 41
    some = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = [some(30) for _ in range(400)]
    side = lambda: rng.choice(shared) if rng.random() < 0.2 else some(30)
    return [(i, side() + line + side()) for i in range(20_000)]


def test_a_line_in_every_document(spark, monkeypatch):
    """The minimizers of the line are found, and its stretches spread over the shards."""
    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", 1 << 12)
    asked, estimate = [], suffix_dedup.hot_keys
    monkeypatch.setattr(suffix_dedup, "hot_keys", lambda packs: asked.append(estimate(packs)) or asked[0])
    rows = boilerplate_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = [(r.id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(slow_removal(rows)) and sum(bool(s) for _, _, s, _ in got) > 500

    packs = list(packs_of(rows, 1000))
    sizes = {k: sum(map(len, v)) for k, v in minimizers(packs).items()}
    hot = {k for k, v in minimizers(packs).items() if len(v) >= 1 << 12}
    assert hot and max(sizes.values()) > 1_000_000
    assert max(sizes, key=sizes.get) in asked[0][0].tolist() and asked[0][1] > 1 << 12
    import pyarrow as pa
    ask = [r for p in packs for b in suffix_dedup.asking(1)(iter([pa.RecordBatch.from_pydict(
        {"pack": [p[0]], "ids": [p[1]], "sizes": [p[2]], "data": [p[3]]})])) for r in b.to_pylist()]
    told = suffix_dedup.counting(pa.Table.from_pylist(ask)).to_pylist()
    largest = {}
    for known in ([], hot):
        shard = {}
        for p in packs:
            sent = suffix_dedup.sending(64, 1, Held(known))(
                pa.table({"pack": [p[0]], "ids": [p[1]], "sizes": [p[2]], "data": [p[3]]}),
                pa.Table.from_pylist([r for r in told if r["pack"] == p[0]]))
            for r in sent.to_pylist():
                data = suffix_dedup.split(r["stretches"], *suffix_dedup.STRETCH)
                shard[r["shard"]] = shard.get(r["shard"], 0) + len(data[5])
        largest[bool(known)] = max(shard.values()) / sum(shard.values())
    assert largest[False] > 0.5 and largest[True] < 0.05


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op5_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    want = {i: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
            for i, n, spans, kept in slow_removal([tuple(r) for r in rows])}
    assert got == want
    assert any(n for _, n, _, _ in want.values())


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
