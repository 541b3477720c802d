"""Runs against a scan of every lag, the query against a plain computation."""
import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from quarry.llm import periodic
from quarry.llm.queries import op11_periodic_runs
from quarry.llm.words import slices, split_words

SPACES = r"[^\x20\x09-\x0D]+"


def slow_runs(words, least=6, power=4):
    n, out = len(words), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, power * q):
                run = words[i:i + size]
                if not any(run[p:] == run[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = re.findall(SPACES, text or "")
    n = len(words)
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4),
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("least, power", [(6, 4), (5, 3), (9, 4), (20, 3)])
def test_runs_of_made_up_texts(least, power):
    rng = random.Random(least)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            words = []
            for _ in range(rng.randint(0, 4)):
                period = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 12))]
                words += (period * 8)[:rng.randint(0, 60)] + [rng.randint(0, 3) for _ in range(rng.randint(0, 3))]
            docs.append(words)
        ends = np.cumsum([len(d) for d in docs])
        got = periodic.text_runs(np.array(sum(docs, []), dtype=np.int64), ends, least, power)
        begins = [0, *ends[:-1].tolist()]
        assert [tuple(r) for r in got.tolist()] == [(b + s, n, q) for b, d in zip(begins, docs, strict=True) for s, n, q in slow_runs(d, least, power)]


def test_a_furthest_word_stops_extensions(monkeypatch):
    calls = []
    real = periodic.agreeing
    monkeypatch.setattr(periodic, "agreeing", lambda x, y: calls.append(1) or real(x, y))
    codes = np.tile(np.arange(7), 3000)
    assert periodic.text_runs(codes, np.array([len(codes)])).tolist() == [[0, 21000, 7]]
    assert len(calls) <= 4


def test_words_are_cut_at_white_space_only():
    texts = [b" a\tb\x0bb\n", None, "é x y\x00z".encode(), b"", b"a" * 5 + b"\x0c\x0d" + b"b"]
    got = split_words(texts)
    want = [re.findall(SPACES, (t or b"").decode()) for t in texts]
    words = [w.decode() for w in got.words.to_pylist()]
    assert words == sum(want, []) and got.ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert [got.kinds[int(c)].as_py().decode() for c in got.codes] == words
    assert got.joined(np.ones(len(words), dtype=bool)).to_pylist() == [" ".join(w) for w in want]
    assert list(slices([b"x" * 5, None, b"y" * 20, b"", b"z"], 10)) == [(0, 2), (2, 3), (3, 5)]


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 90)))) for i in range(400)]
    rows += [(10, "a a  a\ta a a"), (None, "b c " * 20), (None, None), (500, None), (501, ""), (502, " \n\t"), (503, "one"),
             (504, "same words " * 4), (504, "same words " * 4), (505, " ".join(str(i % 1009) for i in range(9000)))]
    (spark.createDataFrame([(i, t, "en", t, len(t or ""), i) for i, t in rows],
                           "doc_id long, text string, lang string, source string, n_chars long, id long")
     .repartition(3).write.parquet(str(tmp_path / "documents.parquet")))
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((slow_row(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 25


def test_empty_table(spark):
    assert periodic.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert periodic.find_runs(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == [(1, 0, [], "")]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=str) == sorted((slow_row(*d) for d in docs), key=str)
