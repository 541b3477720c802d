"""Documents from a directory of files.

* ``.txt``: ``spark.read.text(wholetext=True)`` — one row per file, JVM only.
* ``.docx``: ``binaryFile`` + ``mapInPandas`` over Arrow batches: the zip's
  ``word/document.xml`` is parsed with the standard library into body
  paragraphs; the text is the paragraphs, each followed by a newline.
* ``.pdf``: ``binaryFile`` + a *user-supplied* extractor (no PDF parser ships):
  ``extractor(bytes) -> list[str]`` of page texts, joined with no separator.

Suffixes are matched case-sensitively on the file name and the scan is not
recursive, as in the reference; other files are ignored.
"""
from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.docs import concat_ordered

# --- fixed values -----------------------------------------------------------
W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SUFFIXES = (".pdf", ".docx", ".txt")
# ----------------------------------------------------------------------------

PARTS_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("part_no", T.IntegerType()),
                             T.StructField("text", T.StringType())])


def _binary(spark: SparkSession, directory: str, suffix: str) -> DataFrame:
    """Files of one kind; the glob keeps the bytes of other files unread."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "false")
            .option("pathGlobFilter", f"*{suffix}").load(directory.rstrip("/")).select("path", "content"))


def docx_paragraphs(data: bytes) -> list[str]:
    """Body paragraphs of a .docx (runs' text, tabs and breaks)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body = root.find(f"{W_NS}body")
    out = []
    for p in (body.findall(f"{W_NS}p") if body is not None else []):
        buf = []
        for el in p.iter():
            if el.tag == f"{W_NS}t":
                buf.append(el.text or "")
            elif el.tag == f"{W_NS}tab":
                buf.append("\t")
            elif el.tag in (f"{W_NS}br", f"{W_NS}cr"):
                buf.append("\n")
        out.append("".join(buf))
    return out


def _parts_with(fn: Callable[[bytes], list[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for i, t in enumerate(fn(bytes(content))):
                    rows.append((path, i, t))
            yield pd.DataFrame(rows, columns=["path", "part_no", "text"])
    return run


def docx_scan(spark: SparkSession, directory: str) -> DataFrame:
    """``path, text`` — paragraphs each followed by ``\\n`` (A3)."""
    parts = _binary(spark, directory, ".docx").mapInPandas(_parts_with(docx_paragraphs), PARTS_SCHEMA)
    return concat_ordered(parts, "path", "part_no", suffix="\n")


def binary_scan(spark: SparkSession, directory: str, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """S3: ``path, text`` — page texts joined with no separator (A2)."""
    parts = _binary(spark, directory, ".pdf").mapInPandas(_parts_with(extractor), PARTS_SCHEMA)
    return concat_ordered(parts, "path", "part_no")


def text_scan(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """``path, text`` — each ``.txt`` file whole (UTF-8)."""
    df = (spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.txt")
          .text(directory.rstrip("/"), wholetext=True))
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def directory_scan(spark: SparkSession, directory: str,
                   pdf_extractor: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Every ``.pdf`` / ``.docx`` / ``.txt`` file of one directory, as
    ``path, name, kind, text``; other files are ignored.  PDFs need an
    extractor; a directory that has some cannot be read without one."""
    parts = [text_scan(spark, directory).withColumn("kind", F.lit("txt")),
             docx_scan(spark, directory).withColumn("kind", F.lit("docx"))]
    if pdf_extractor is not None:
        parts.append(binary_scan(spark, directory, pdf_extractor).withColumn("kind", F.lit("pdf")))
    elif not _binary(spark, directory, ".pdf").select("path").isEmpty():
        raise ValueError(f"{directory} has PDF files; pass pdf_extractor to read them")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).select("path", "name", "kind", "text")
