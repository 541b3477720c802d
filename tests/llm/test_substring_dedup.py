"""Automata against plain search, removal against a direct computation."""
import hashlib
import random
import re

import numpy as np
import pytest
import zstandard

from quarry.llm import substring_dedup, suffix_dedup
from quarry.llm.queries import op13_substring_dedup

NULL_ID = suffix_dedup.NULL_ID


@pytest.mark.parametrize("kinds", [1, 2, 3, 9])
def test_matching_statistics(kinds):
    rng = random.Random(kinds)
    for _ in range(150):
        reference = [[rng.randrange(kinds) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(0, 6))]
        length = rng.randint(1, 5)
        a = substring_dedup.Automaton()
        for i, words in enumerate(reference):
            a.add(words, i * 10)
        asked = [rng.randrange(kinds + 1) for _ in range(40)]
        has = lambda w, x: any(w[k:k + length] == x for k in range(len(w) - length + 1))  # noqa: B023, E731
        want = [(p, next(i * 10 for i, w in enumerate(reference) if has(w, asked[p:p + length])))
                for p in range(len(asked) - length + 1) if any(has(w, asked[p:p + length]) for w in reference)]
        assert list(a.matches(asked, length)) == want


def slow_removal(rows, length=13):
    """(id, text) rows to (id, n_words, spans, kept)."""
    words = [(NULL_ID if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    owner = {}
    for i, w in words:
        for p in range(len(w) - length + 1):
            s = tuple(w[p:p + length])
            owner[s] = min(owner.get(s, NULL_ID), i)
    out = []
    for (raw, _), (i, w) in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if owner[tuple(w[p:p + length])] < i:
                gone[p:p + length] = [True] * length
        edges = [p for p in range(len(w) + 1) if (p < len(w) and gone[p]) != (p > 0 and gone[p - 1])]
        out.append((raw, len(w), list(zip(edges[::2], edges[1::2], strict=True)), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def planted_rows():
    rng = random.Random(6)
    text = lambda n, kinds=400: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    shared, line, base = text(60), text(12), text(500)
    rows = [(i, f"{text(rng.randint(0, 90))}\n{rng.choice([shared, line, shared[:150], ''])} {text(rng.randint(0, 90))}") for i in range(3, 260)]
    rows += [(1000 + i, base) for i in range(40)] + [(900, base + " " + shared), (2, text(20) + " " + base)]
    rows += [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(300, 360)]
    rows += [(400, "x " * 500), (401, "x " * 30), (402, "x " * 13), (403, "x " * 12), (404, "  x\t" * 13)]
    rows += [(None, base), (None, shared), (None, None), (500, None), (501, ""), (502, " \n"), (503, "é ü 日本 " * 8), (504, "é ü 日本 " * 8)]
    rows += [(600, shared), (600, shared), (1, line), (-5, shared[40:300]), (700, text(9000)), (701, text(30, 5) + " " + text(9000))]
    rng.shuffle(rows)
    return rows


def removed(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, pack string, owner string").repartition(4)
    return sorted([(r.id, r.n_words, [(s.start, s.end) for s in r.spans], r.kept)
                   for r in substring_dedup.remove_passages(docs, **more).collect()], key=str)


def test_removal(spark):
    rows = planted_rows()
    got = removed(spark, rows)
    assert got == sorted(slow_removal(rows), key=str)
    assert sum(bool(r[2]) for r in got) > 60


def test_small_packs_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 50)
    monkeypatch.setattr(substring_dedup, "PART_WORDS", 100)
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 20000)
    rows = planted_rows()
    small = [(i, t) for i, t in rows if len(t or "") < 5000]
    assert removed(spark, small) == sorted(slow_removal(small), key=str)
    assert removed(spark, small, length=4) == sorted(slow_removal(small, 4), key=str)


def test_a_group_of_copies_is_one_span_a_pack():
    rng = random.Random(1)
    text = " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(300)).encode()
    p = substring_dedup.Pack(list(range(500)), [len(text)] * 500, zstandard.compress(text * 500))
    h = p.hashes(13, 1)
    at = np.flatnonzero(h)
    w, hashes = substring_dedup.Windows.distinct(p, at, h[at])
    assert len(hashes) == 288 and w.several.all() and (w.owner[w.head] == 0).all() and len(w.at) == 288 * 500
    assert [x.tolist() for x in substring_dedup.spans(np.sort(w.at[w.head]), np.zeros(288))] == [[0], [288]]


def test_odd_tables(spark):
    assert removed(spark, []) == []
    assert removed(spark, [(1, None), (None, ""), (2, "a b c")]) == sorted([(1, 0, [], ""), (None, 0, [], ""), (2, 3, [], "a b c")], key=str)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in op13_substring_dedup(spark, "/root/testdata/sf0.001").collect()]
    want = [(i, n, sum(b - a for a, b in spans), hashlib.sha256(kept.encode()).hexdigest()) for i, n, spans, kept in slow_removal([tuple(d) for d in docs])]
    assert sorted(got) == sorted(want) and any(r[2] for r in want)
