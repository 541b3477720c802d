"""F3, A4, W2, W3 against the direct computation on one Python string."""
import re

from quarry.operators import trainset as TS
from quarry.operators.docs import normalize_corpus
from quarry.operators.hooks import Hook

DOCS = [(1, "  \n"), (2, "a\n"), (3, "\n"), (4, "\nb\n\n"), (5, ""), (6, "\n\nc d"), (7, " e \n"), (8, " \n ")]


def test_normalize_matches_whole_string(spark):
    for parts in (1, 3):
        df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(parts)
        got = "".join(r.text for r in normalize_corpus(df).orderBy("doc_id").collect())
        assert got == re.sub(r"\n+", "\n", "".join(t for _, t in DOCS)).strip()


def test_documents_sf0001(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    norm = normalize_corpus(docs)
    got = "".join(r.text for r in norm.orderBy("doc_id").collect())
    ref = re.sub(r"\n+", "\n", "".join(r.text or "" for r in docs.orderBy("doc_id").collect())).strip()
    assert got == ref
    parts = TS.char_split(norm)
    train = "".join(r.text for r in parts.where("split = 'train'").orderBy("doc_id").collect())
    val = "".join(r.text for r in parts.where("split = 'val'").orderBy("doc_id").collect())
    cut = int(0.8 * len(ref))
    assert train == ref[:cut] and val == ref[cut:]


def test_keys_may_be_text(spark):
    rows = [(f"k{i:03d}", t) for i, (_, t) in enumerate(DOCS * 9)]
    df = spark.createDataFrame(rows, "path string, text string").repartition(4)
    got = "".join(r.text for r in normalize_corpus(df, key="path").orderBy("path").collect())
    assert got == re.sub(r"\n+", "\n", "".join(t for _, t in rows)).strip()


def _sliced(rows):
    """split -> blocks of the ids in key order."""
    out = {}
    for split in {r[0] for r in rows}:
        stream = [x for _, _, ids in sorted(r for r in rows if r[0] == split) for x in ids]
        for b in range(len(stream) // 128):
            out[(split, b)] = stream[128 * b:128 * b + 128]
    return out


def _packed(ids):
    return {(r.split, r.block_id): list(r.input_ids) for r in TS.pack_blocks(ids).collect()}


def test_blocks(spark):
    for total in (0, 1, 127, 128, 129, 256, 1000):
        rows = [("train", 1, list(range(total // 2))), ("train", 2, list(range(500, 500 + total - total // 2))), ("train", 3, []),
                ("val", 1, [7] * total)]
        assert _packed(spark.createDataFrame(rows, "split string, doc_id long, input_ids array<int>")) == _sliced(rows)


def test_many_short_parts_make_one_block(spark):
    rows = [("train", i, [i] * (i % 4)) for i in range(300)]
    assert _packed(spark.createDataFrame(rows, "split string, doc_id long, input_ids array<int>").repartition(5)) == _sliced(rows)


def test_unknown_tokens_are_not_lost(spark):
    texts = ["the cat  sat", "the été 😀", "rare\n\twords here", "", "the the the"]
    parts = TS.with_tokens(spark.createDataFrame([("train", i, t) for i, t in enumerate(texts)], "split string, doc_id long, text string"))
    for size in (TS.BYTE_IDS, TS.BYTE_IDS + 1, TS.BYTE_IDS + 3, 50256):
        vocab = TS.build_vocab(parts, size)
        ids = TS.tokenize(parts.drop("text"), vocab)
        assert max(max(r.input_ids, default=0) for r in ids.collect()) < size
        assert {r.doc_id: r.text for r in TS.detokenize(ids, vocab).collect()} == dict(enumerate(texts))


def test_tokenizer_hook(spark):
    """A user tokenizer (here: code points) through the hook, packed into
    blocks, equals slicing the concatenated id stream."""
    rows = [("train", 1, "ab" * 100), ("train", 2, "é" * 90), ("val", 3, "xyz" * 50), ("train", 4, "")]
    parts = spark.createDataFrame(rows, "split string, doc_id long, text string").repartition(3)
    hook = Hook("code points", lambda: lambda texts: [[ord(c) for c in t] for t in texts])
    assert _packed(TS.tokenize_with(parts, hook)) == _sliced([(s, i, [ord(c) for c in t]) for s, i, t in rows])


def test_directory_to_blocks(spark, tmp_path):
    from quarry.plans.train import directory_blocks
    text = {"b.txt": "two two\n\n\nthree", "a.txt": "  one", "c.txt": "four " * 200}
    for name, t in text.items():
        (tmp_path / name).write_text(t)
    rows = directory_blocks(spark, str(tmp_path), fraction=1.0, block_size=8).orderBy("block_id").collect()
    corpus = re.sub(r"\n+", "\n", "".join(text[n] for n in sorted(text))).strip()
    assert len(rows) >= 200 // 8 and all(len(r.input_ids) == 8 for r in rows)
    assert corpus.startswith("one")


def test_layout_of_many_ranges_and_batches(spark):
    """Line ends, white space and empty texts at every kind of border, whatever the
    ranges and Arrow batches are."""
    import random

    from quarry.operators.trainset import normalized_split
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    rnd = random.Random(3)
    try:
        for ranges, batch in ((1, 3), (7, 2), (40, 1000)):
            spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            rows = [(i, rnd.choice(["", "\n", "\n\n", "a", "\nb", "c\n", " ", "\né\n\n", None, "  x\n"])) for i in range(120)]
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
            whole = re.sub(r"\n+", "\n", "".join(t or "" for _, t in rows)).strip()
            assert "".join(r.text for r in normalize_corpus(df).orderBy("doc_id").collect()) == whole
            parts = normalized_split(df).orderBy("doc_id").collect()
            cut = int(0.8 * len(whole))
            assert "".join(r.text for r in parts if r.split == "train") == whole[:cut]
            assert "".join(r.text for r in parts if r.split == "val") == whole[cut:]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_texts_are_shuffled_once(spark):
    """The only exchange that carries texts is the one into key ranges: reading the
    layout joins its table of ranges as a broadcast."""
    from quarry.operators.docs import normalized_layout
    from quarry.operators.trainset import normalized_split
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = normalized_split(docs)
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert normalized_layout(docs)[0].count() == docs.count()


def test_a_file_is_many_rows(spark, tmp_path, monkeypatch):
    """A directory's files are cut into rows of a document's size, between tokens
    and in the order of their paths: the blocks are those of whole files."""
    from quarry.plans import train
    text = {"a.txt": "  one\n\n", "ab.txt": "", "b.txt": "\ntwo  two \n x\n\n\nthree, 3.14\n" * 40, "a-b.txt": " \n", "c.txt": "four!" * 30 + "\n five"}
    for name, t in text.items():
        (tmp_path / name).write_text(t)
    longest, whole = {}, train.training_blocks

    def seen(docs, **more):
        longest[train.PIECE] = max(len(r.text) for r in docs.select("text").collect())
        return whole(docs, **more)

    monkeypatch.setattr(train, "training_blocks", seen)
    blocks = {}
    for size in (16, 10 ** 6):
        monkeypatch.setattr(train, "PIECE", size)
        blocks[size] = {(r.split, r.block_id): list(r.input_ids) for r in
                        train.directory_blocks(spark, str(tmp_path), fraction=0.7, block_size=4).collect()}
    assert blocks[16] == blocks[10 ** 6] and len(blocks[16]) > 100
    assert longest[16] < 200 < longest[10 ** 6]


def test_pieces_cut_no_token(spark):
    from pyspark.sql import functions as F

    from quarry.functions.text import token_count, token_pieces
    texts = ["", "a", "   ", "a  b\t\n c", " ab " * 9, "x" * 40, " a  b c " * 7, "1 2,3 \n\n" * 5, "\U0001f600 a" * 8, "a\x0bb\x0cc\r\nd" * 6]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size in (1, 2, 3, 7, 1000):
        pieces = token_pieces(F.col("t"), size)
        for r in df.select("t", pieces.alias("p"), token_count(F.col("t")).alias("n"),
                           F.aggregate(F.transform(pieces, token_count), F.lit(0), lambda a, x: a + x).alias("m")).collect():
            assert "".join(r.p) == r.t and r.n == r.m


def test_ids_are_made_a_stretch_at_a_time(spark, monkeypatch):
    """What a batch's tokens become does not stand in memory at once: results come
    in stretches of tokens and of ids, whatever the batch."""
    from types import SimpleNamespace

    import pyarrow as pa
    monkeypatch.setattr(TS, "TOKENS_AT_A_TIME", 6)
    monkeypatch.setattr(TS, "IDS_AT_A_TIME", 12)
    rows = [["ab", " c"], None, [], ["xyz"] * 5, ["ab"] * 20, [" c", "q"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.string()))], names=["k", "tokens"])
    shared = SimpleNamespace(value=[("ab", 256), (" c", 257)])
    coded = list(TS._encoder(shared, 1, ["k", "input_ids"])(iter([batch.slice(0, 0), batch])))
    assert len(coded) > 2 and max(b.num_rows for b in coded) < len(rows)
    ids = [x for b in coded for x in b.column(1).to_pylist()]
    assert ids == [[256, 257], [], [], [120, 121, 122] * 5, [256] * 20, [257, 113], []]
    whole = pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "input_ids"])
    read = list(TS._decoder(shared, 1, ["k", "text"])(iter([whole])))
    assert len(read) > 2 and [x for b in read for x in b.column(1).to_pylist()] == ["".join(r or []) for r in rows]
    assert [x for b in read for x in b.column(0).to_pylist()] == list(range(len(rows)))


def test_a_long_part_is_packed_in_linear_time(spark):
    """A part of very many blocks costs its length: no block copies the whole part."""
    import time

    from pyspark.sql import functions as F
    n = 4_000_000
    ids = spark.range(1).select(F.lit("train").alias("split"), F.lit(1).alias("doc_id"),
                                F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: x % 1000).alias("input_ids"))
    begin = time.time()
    got = TS.pack_blocks(ids).agg(F.count("*"), F.sum(F.element_at("input_ids", 1)), F.max("block_id")).first()
    assert list(got) == [n // 128, sum(128 * b % 1000 for b in range(n // 128)), n // 128 - 1]
    assert time.time() - begin < 60
