"""Fingerprints and components against a direct computation."""
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quarry.llm import simhash
from quarry.llm.components import components


def slow_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4)
        for j in near:
            a, b = find(int(j)), find(i)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


TEXTS = [None, "", " \t\n", "one", "Two Words", "a b c d", "A B C D", "a b c d e É", "x " * 3000,
         "the quick brown fox jumps over the lazy dog", "The quick\nbrown fox  jumps over the lazy dog"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(5000))
    whole = slow_fingerprint(text)
    import quarry.llm.common as common
    real = common.text_pieces
    monkeypatch.setattr(simhash, "text_pieces", lambda data: real(data, 50))
    assert simhash.fingerprint(text.encode()) == whole


def near_values(rng, centres, each, bits=4):
    out = []
    for c in rng.integers(0, 2 ** 63, centres, dtype=np.uint64):
        for _ in range(each):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, bits + 1), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("block,centres,each", [(4096, 40, 12), (16, 3, 150)])
def test_links_connect_what_all_pairs_connect(monkeypatch, block, centres, each):
    """The kernels without Spark: sorted keys in odd batches, blocks met pairwise."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = near_values(np.random.default_rng(centres), centres, each)
    keyed = [(k, f) for b in simhash.chain_keys(iter([pa.RecordBatch.from_arrays(
        [pa.array(fps.view(np.int64))], names=["fp"])])) for k, f in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    keyed.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in keyed[i:i + 37]]), pa.array([f for _, f in keyed[i:i + 37]])],
                                          names=["key", "fp"]) for i in range(0, len(keyed), 37)]
    rows = [r for b in simhash.key_links(4)(iter(batches)) for r in b.to_pylist()]
    edges = [(r["a"], r["b"]) for r in rows if r["kind"] == 0]
    wide = {}
    for r in rows:
        if r["kind"] == 1:
            wide.setdefault(r["a"], {}).setdefault(r["block"], []).append(r["b"])
    for key, parts in wide.items():
        for i in parts:
            for j in parts:
                if i < j:
                    t = simhash.block_links(4)(pa.table({"key": pa.array([key] * len(parts[i] + parts[j])),
                                                         "fp": pa.array(parts[i] + parts[j])}))
                    edges += list(zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True))
    place = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    for a, b in edges:
        assert bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 4
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in edges:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == slow_components(fps)
    if block == 16:
        assert wide


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def test_near_duplicates(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    data = [(r.doc_id, r.text, "extra") for r in rows] + [(None, None, "x"), (9001, None, "x"), (9000, "", "x"),
                                                          (9002, rows[0].text, None), (9002, rows[0].text, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(data)
    fps = np.array([slow_fingerprint(t) for _, t, _ in data], dtype=np.uint64)
    groups = slow_components(fps)
    want = sorted((d, int(f), min((data[j][0] for j in range(len(data)) if groups[j] == groups[i] and data[j][0] is not None),
                                  default=None)) for i, ((d, _, _), f) in enumerate(zip(data, fps.view(np.int64), strict=True)) if d is not None)
    assert sorted((r.id, r.fp, r.component) for r in got if r.id is not None) == want
    assert [r.component for r in got if r.id is None] == [9000]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
