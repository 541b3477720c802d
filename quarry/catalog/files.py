"""File-source queries (S5, S6).  The files are written by Spark from the
``documents`` table into a fresh folder under the checkpoint directory: one
``.txt`` file per thousand ids, so no file grows with the corpus, holding its
documents in ``doc_id`` order, one line each."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import register
from quarry.session import scratch_path
from quarry.sources.files import directory_scan, text_scan
from quarry.sources.tables import table

PER_FILE = 1000
FILES_SQL = f"""files AS (SELECT doc_id // {PER_FILE} AS file_no, string_agg(text || chr(10), '' ORDER BY doc_id) AS text
FROM documents WHERE text IS NOT NULL GROUP BY ALL)"""


def _write_files(spark, sf) -> str:
    path = scratch_path(spark, "files")
    docs = table(spark, sf, "documents", ["doc_id", "text"]).where(F.col("text").isNotNull())
    numbered = docs.withColumn("file_no", F.floor(F.col("doc_id") / PER_FILE))
    (numbered.repartition("file_no").sortWithinPartitions("file_no", "doc_id")
     .select("file_no", "text").write.partitionBy("file_no").text(path))
    return path


def _file_no():
    return F.regexp_extract("path", r"file_no=([0-9]+)/", 1).cast("bigint").alias("file_no")


@register("text_scan", "S5", f"WITH {FILES_SQL} SELECT file_no, text FROM files")
def q_text_scan(spark, sf):
    return text_scan(spark, _write_files(spark, sf), recursive=True).select(_file_no(), "text")


@register("directory_scan", "S6", f"""WITH {FILES_SQL}
SELECT file_no, 'txt' AS kind, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS digest FROM files""")
def q_directory_scan(spark, sf):
    """Suffix dispatch over the files of several directories (a glob), one row
    per file."""
    d = directory_scan(spark, _write_files(spark, sf) + "/file_no=*")
    return d.select(_file_no(), "kind", F.length("text").cast("bigint").alias("n_chars"),
                    F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
