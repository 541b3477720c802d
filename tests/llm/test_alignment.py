"""Alignment against both libraries, token by token."""
import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import alignment
from quarry.llm.queries import op12_token_alignment

LETTERS = alignment.byte_letters()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)


def tokens(libraries, text):
    """(id, bytes) lists of both; nothing where they do not spell the text."""
    if not text:
        return [], []
    one, two = libraries
    a = [(i, bytes(LETTERS[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode())
         for i in two.encode(text)]
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def slow_rows(libraries, rows):
    links, shown, sizes = [], [], []
    for _, text in rows:
        a, b = tokens(libraries, text)
        groups, mine, i, j, at_a, at_b = [([], [])], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                at_a += len(a[i][1])
                groups[-1][0].append(a[i][0])
                i += 1
            else:
                at_b += len(b[j][1])
                groups[-1][1].append(b[j][0])
                j += 1
            if at_a == at_b:
                mine.append((a[i - 1][0], b[j - 1][0]))
                groups.append(([], []))
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups[:-1])
        links.append(mine)
        sizes.append((len(a), len(b), len(groups) - 1))
        shown.append(hashlib.sha256(text_of.encode()).hexdigest() if mine else "")
    count = Counter(x for mine in links for x in mine)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(i, *n, len(mine), sum(count[x] == top[x[1]] for x in mine), sum(count[x] for x in mine), s)
            for (i, _), n, mine, s in zip(rows, sizes, links, shown, strict=True)], count


def made_up():
    rng = random.Random(4)
    parts = ["the", " of", "don't", " <|endoftext|>", "</s>", "<0x41>", "<unk>", "é", "日本語", "😀", "\n", "\t", "  ", "    x", "a", "Zürich",
             "12345", "!!", "'ll", "\r\n", "\x0b", "ﬁ", "é", " ", "naïve", " and", "​", "नमस्ते"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]
    return rows + [(2000, None), (2001, ""), (2002, " "), (2003, "▁"), (2004, "a ▁ b"), (2005, "\x00"), (None, "the end"), (None, None),
                   (2006, "the end"), (2006, "the end"), (2007, "ab " * 30000), (2008, "x" * 5000), (2009, "  lead"), (2011, "a" + " " * 4094 + "b"), (2012, "a" + "\n" * 5000 + "b"), (2013, " " * 9000),
                   (2010, "�")]


def frame(spark, rows, path):
    (spark.createDataFrame([(i, t, "en", t, i, "x") for i, t in rows],
                           "doc_id long, text string, hash string, source string, id long, copies string")
     .repartition(3).write.parquet(f"{path}/documents.parquet"))


def test_query(spark, tmp_path, libraries):
    rows = made_up()
    frame(spark, rows, tmp_path)
    got = op12_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, _ = slow_rows(libraries, rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] == 0 for r in want) > 3 and any(r[5] < r[4] for r in want)


def test_slices_of_counts_add_up(spark, tmp_path, libraries):
    rows = made_up()
    frame(spark, rows, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got, counts = alignment.align(docs, alignment.load(), slice_pairs=200)
    want, pairs = slow_rows(libraries, rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert {(r.a, r.b): r.n for r in counts.collect()} == dict(pairs)


def test_every_text_may_be_hot_or_none(spark, tmp_path, libraries, monkeypatch):
    rows = [(i, "one and the same text") for i in range(50)] + [(100 + i, f"another {i}") for i in range(50)]
    frame(spark, rows, tmp_path)
    want, _ = slow_rows(libraries, rows)
    for share in (1, 4, 10 ** 6):
        monkeypatch.setattr(alignment, "HOT_SHARE", share)
        assert sorted(tuple(r) for r in op12_token_alignment(spark, str(tmp_path)).collect()) == sorted(want)


def test_no_rows(spark, tmp_path):
    frame(spark, [], tmp_path)
    assert op12_token_alignment(spark, str(tmp_path)).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    got, counts = alignment.align(docs, alignment.load())
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")] and counts.collect() == []


def test_whole_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in op12_token_alignment(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(slow_rows(libraries, [tuple(d) for d in docs])[0])
