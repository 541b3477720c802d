"""Queries for document text: cleaning, corpus normalisation, assembly and
chunking (F1-F3, A2, A3, A6, U2, U3, M1)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import register
from quarry.catalog import sqlfrag as Q
from quarry.functions.text import STRIP_PATTERN, WS_CLASS, clean_text
from quarry.operators.chunk import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents
from quarry.operators.docs import concat_ordered, distinct_docs, normalize_corpus, union_docs
from quarry.plans.ingest import page_documents
from quarry.sources.tables import scan_pages, table


@register("clean_text", "F1,F2", f"""SELECT doc_id, {Q.clean('text')} AS text,
CAST(length({Q.clean('text')}) AS BIGINT) AS n_chars FROM documents""")
def q_clean_text(spark, sf):
    d = table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", clean_text(F.col("text")).alias("text"))
    return d.withColumn("n_chars", F.length("text").cast("bigint"))


def normalize_corpus_sql() -> str:
    ws = WS_CLASS
    non_ws = f"[^{WS_CLASS[1:-1]}]"
    return f"""c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\n+', chr(10), 'g') AS c FROM documents),
p AS (SELECT doc_id, c, last_value(CASE WHEN length(c) > 0 THEN right(c, 1) END IGNORE NULLS)
        OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
      regexp_matches(c, {Q.sql_lit(non_ws)}) AS has FROM c),
q AS (SELECT doc_id, has, CASE WHEN prefix(c, chr(10)) AND prev = chr(10) THEN substring(c, 2) ELSE c END AS c2 FROM p),
e AS (SELECT min(doc_id) FILTER (WHERE has) AS f, max(doc_id) FILTER (WHERE has) AS l FROM q),
norm AS (SELECT doc_id, CASE
   WHEN e.f IS NULL OR doc_id < e.f OR doc_id > e.l THEN ''
   WHEN doc_id = e.f AND doc_id = e.l THEN regexp_replace(regexp_replace(c2, {Q.sql_lit('^' + ws + '+')}, ''), {Q.sql_lit(ws + '+$')}, '')
   WHEN doc_id = e.f THEN regexp_replace(c2, {Q.sql_lit('^' + ws + '+')}, '')
   WHEN doc_id = e.l THEN regexp_replace(c2, {Q.sql_lit(ws + '+$')}, '')
   ELSE c2 END AS text FROM q, e)"""


@register("collapse_newlines", "F3", lambda: f"WITH {normalize_corpus_sql()} SELECT doc_id, text FROM norm")
def q_collapse_newlines(spark, sf):
    return normalize_corpus(table(spark, sf, "documents", ["doc_id", "text"]))


@register("distinct_docs", "A6,U2", "SELECT DISTINCT source, text FROM documents")
def q_distinct_docs(spark, sf):
    return distinct_docs(table(spark, sf, "documents", ["source", "text"]))


@register("union_docs", "U3", lambda: f"""SELECT url AS source, {Q.html_to_text_sql('html')} AS text FROM pages
UNION ALL SELECT source, text FROM documents""")
def q_union_docs(spark, sf):
    web = page_documents(scan_pages(spark, sf))
    return union_docs(web, table(spark, sf, "documents", ["source", "text"]))


@register("concat_parts", "A2", """SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def q_concat_parts(spark, sf):
    """Parts of one document (here: the turns of a conversation) in order, no separator."""
    return concat_ordered(table(spark, sf, "conversations"), "conv_id", "turn")


@register("concat_paragraphs", "A3", """SELECT conv_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def q_concat_paragraphs(spark, sf):
    return concat_ordered(table(spark, sf, "conversations"), "conv_id", "turn", suffix="\n")


def chunk_sql(src: str, key: str, text_expr: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> str:
    """DuckDB recursive CTE over chunk starts (same rule as the Spark fold,
    written independently): yields ``{key}, chunk_idx, start, text``."""
    def fs(x):
        return (f"(CASE WHEN instr(substring(t, ({x}) + 1), ' ') = 0 THEN n "
                f"ELSE ({x}) + instr(substring(t, ({x}) + 1), ' ') - 1 END)")

    def end(a):
        return (f"(CASE WHEN n - ({a}) <= {size} THEN n ELSE ({a}) + "
                f"length(regexp_replace(substring(t, ({a}) + 1, {size + 1}), '[^ ]*$', '')) - 1 END)")

    return f"""ch_d AS (SELECT {key} AS k, {text_expr} AS t FROM {src}),
ch_n AS (SELECT k, t, length(t) AS n FROM ch_d WHERE t IS NOT NULL),
ch_c AS (
  SELECT k, t, n, CAST(0 AS BIGINT) AS a, CAST({end('0')} AS BIGINT) AS b FROM ch_n
  UNION ALL
  SELECT k, t, n, a2, {end('a2')} FROM (
    SELECT k, t, n, CASE WHEN x = a THEN a ELSE {fs('x')} END AS a2 FROM (
      SELECT k, t, n, a, greatest(a, b - {overlap}, {fs('b + 1')} - {size}) AS x FROM ch_c WHERE b < n))),
chunks AS (SELECT k AS {key}, CAST(row_number() OVER (PARTITION BY k ORDER BY a) - 1 AS BIGINT) AS chunk_idx,
  CAST(a AS BIGINT) AS start, txt AS text FROM (
  SELECT k, a, regexp_replace(substring(t, a + 1, b - a), {Q.sql_lit(STRIP_PATTERN)}, '', 'g') AS txt FROM ch_c)
  WHERE txt <> '')"""


@register("chunk_documents", "M1", lambda: "WITH RECURSIVE " + chunk_sql("documents", "doc_id", Q.clean("text"))
          + " SELECT doc_id, chunk_idx, start, text FROM chunks")
def q_chunk_documents(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", clean_text(F.col("text")).alias("text"))
    ch = chunk_documents(docs, ["doc_id"], "text")
    return ch.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
                     F.col("start").cast("bigint").alias("start"), "text")
