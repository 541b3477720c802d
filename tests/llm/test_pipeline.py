"""Stages: columns, decisions, odd rows; the whole run on the smallest table."""
import corpus_pipeline
from quarry.llm import secret_scan, simhash, unigram

SF = "/root/testdata/sf0.001"
HEXES = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"


def odd_docs(spark):
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    text = base[0][1]
    rows = [(*r, 1, "s") for r in base] + [
        (None, None, None, None, None, None, None), (None, text, "fr", "src0", len(text), 2, "t"),
        (None, text, "fr", "src0", len(text), 3, "t"), (9000, "", "en", None, 0, 2, "t"), (9001, "12 34", None, "src1", 5, 2, None),
        (base[1][0], base[1][1], base[1][2], base[1][3], base[1][4], 9, "u"), (9002, f"the token = {HEXES} of the", "en", "src2", 1, 2, "t"),
        (9003, "the of and " * 20000, "en", "src2", 220000, 2, "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, score string"), rows


def test_stages_on_odd_rows(spark):
    docs, rows = odd_docs(spark)
    out = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        out[name] = sorted(map(tuple, got.collect()), key=repr)
    assert len(out["language_id"]) == sum(any(c.isalpha() for c in r[1] or "") for r in rows)
    fps = [simhash.fingerprint(r[1].encode() if r[1] is not None else None) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    kept = out["near_duplicates"]
    assert len(kept) == len(set(root))
    for group in set(root):
        ids = [r[0] for r, g in zip(rows, root, strict=True) if g == group]
        assert any(k[0] == min((i for i in ids if i is not None), default=None) for k in kept)
    assert len(out["secrets"]) == len(rows)
    masked = {r[0]: r for r in out["secrets"] if r[0] == 9002}[9002]
    assert secret_scan.MASK in masked[1] and HEXES not in masked[1] and masked[4] == len(masked[1])
    assert {r[0] for r in out["mixture"]} <= {r[0] for r in rows} and len(out["mixture"]) > len(rows)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    model = unigram.load()
    assert got and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "pieces"}
    for r in got:
        assert unigram.decode_ids(model, r.pieces).decode() == r.text
    all_rows = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.3 * all_rows < len({r.doc_id for r in got}) < all_rows
