"""S3-S6 file scans (FIXTURES.md `files/`) and S11 request parsing."""
import io
import os
import tempfile
import zipfile

import pytest

from quarry.sources.files import directory_scan
from quarry.sources.requests import parse_requests


def _docx(paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    xml = f'<?xml version="1.0"?><w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    return buf.getvalue()


def test_directory_scan(spark):
    d = tempfile.mkdtemp(prefix="quarry-files-")
    open(os.path.join(d, "a.txt"), "w").write("plain\ntext")
    open(os.path.join(d, "b.TXT"), "w").write("ignored")
    open(os.path.join(d, "c.md"), "w").write("ignored")
    open(os.path.join(d, "d.docx"), "wb").write(_docx(["one", "two"]))
    open(os.path.join(d, "e.pdf"), "wb").write(b"PAGE1|PAGE2")
    os.makedirs(os.path.join(d, "sub"))
    open(os.path.join(d, "sub", "f.txt"), "w").write("not recursive")
    stub = lambda data: data.decode().split("|")  # noqa: E731  (test extractor)
    got = {r.name: (r.kind, r.text) for r in directory_scan(spark, d, pdf_extractor=stub).collect()}
    assert got == {"a.txt": ("txt", "plain\ntext"), "d.docx": ("docx", "one\ntwo\n"), "e.pdf": ("pdf", "PAGE1PAGE2")}


def test_pdfs_are_not_skipped_in_silence(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert directory_scan(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.pdf").write_bytes(b"x")
    with pytest.raises(ValueError, match="PDF"):
        directory_scan(spark, str(tmp_path))


def test_each_scan_reads_files_of_its_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.docx").write_bytes(_docx(["p"]))
    from quarry.sources.files import _binary
    files = {k: [os.path.basename(f) for f in _binary(spark, str(tmp_path), k).inputFiles()] for k in (".docx", ".txt")}
    assert files == {".docx": ["b.docx"], ".txt": ["a.txt"]}


def test_request_parsing(spark):
    urls = ["/get?msg=a%20b", "/get?msg=a+b", "/get?msg=%zz", "/get?other=1", "/get?msg=", "/get?msg=%C3%A9t%C3%A9",
            "/get?msg=!*'()~"]
    df = spark.createDataFrame([(u,) for u in urls], "request_url string")
    got = [r.msg for r in parse_requests(df).collect()]
    assert got == ["a b", "a b", None, None, "", "été", "!*'()~"]


def test_encode_roundtrip(spark):
    from quarry.sources.requests import to_requests
    qs = ["what is 1+1?", "été & co", "!*'()~ ok"]
    df = spark.createDataFrame([(q,) for q in qs], "question string")
    rows = parse_requests(to_requests(df)).collect()
    assert [r.msg for r in rows] == qs
    assert rows[0].request_url == "/get?msg=what%20is%201%2B1%3F"


def test_a_write_leaves_no_shuffle_files(spark):
    """Tables written on the way and indexes in cells: their shuffles go with the write."""
    import os
    import tempfile
    import time
    from pyspark.sql import functions as F
    from quarry.session import SHUFFLE_CLEANUP, cut_lineage
    from quarry.sources.index_store import load_index, save_index
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    setting = spark.conf.get(SHUFFLE_CLEANUP, None)

    def shuffles():
        return {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x and x.endswith(".data") and os.path.exists(x)}

    def left(most):
        end = time.time() + 20                               # files are deleted a little later
        while (size := sum(os.path.getsize(x) for x in shuffles() - before)) > most and time.time() < end:
            time.sleep(0.2)
        return size

    before = shuffles()
    assert cut_lineage(spark.range(1000).repartition(5, "id")).count() == 1000 and left(1000) <= 1000      # of the count
    vector = F.array(*[F.rand(i).cast("float") for i in range(64)])
    rows = spark.range(3000).select(F.col("id").cast("string").alias("chunk_id"), F.lit("s").alias("source"), F.lit(0).alias("chunk_idx"),
                                    F.lit(0).alias("start"), F.lit("t").alias("text"), vector.alias("embedding"))
    path = tempfile.mkdtemp(prefix="quarry-idx-") + "/index"
    save_index(rows, path, cells=4)
    assert left(200_000) <= 200_000                          # the vectors are 768,000 bytes; distances to the centres are summed up
    assert load_index(spark, path).count() == 3000 and spark.conf.get(SHUFFLE_CLEANUP, None) == setting
