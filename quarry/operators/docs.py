"""Document assembly and corpus normalisation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import WS_CLASS, collapse_newline_runs
from quarry.operators.layout import between, text_layout


def concat_ordered(parts: DataFrame, key: str, order: str, text: str = "text",
                   suffix: str = "", parts_per_range: int = 1024) -> DataFrame:
    """A2 (suffix '') / A3 (suffix '\\n'): one text per ``key`` from its parts in
    ``order`` (a number).  Parts are joined per range of ``parts_per_range``
    order values first and the ranges' texts after that, so no task sorts all
    parts of a long document."""
    piece = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(suffix))

    def in_order(rows: DataFrame, keys: list, by, value) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(by.alias("o"), value.alias("t")))), lambda x: x["t"]), "").alias("_t"))

    ranged = parts.withColumn("_range", F.floor(F.col(order) / parts_per_range))
    some = in_order(ranged, [key, "_range"], F.col(order), piece)
    return in_order(some, [key], F.col("_range"), F.col("_t")).withColumnRenamed("_t", text)


def distinct_docs(docs: DataFrame) -> DataFrame:
    """A set of documents (dedup by columns, not by object identity)."""
    return docs.dropDuplicates(["source", "text"])


def union_docs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union."""
    return a.select("source", "text").unionByName(b.select("source", "text"))


def normalized_layout(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """F3 over the concatenation of all documents in ``key`` order, without building
    it: the layout of the texts with newline runs collapsed (also across document
    borders), and the corpus positions between which it stands when white space is
    stripped at its two ends."""
    rows = docs.select(key, collapse_newline_runs(F.coalesce(F.col(text), F.lit(""))).alias(text))
    rows = rows.withColumn("_solid", F.col(text).rlike(f"[^{WS_CLASS[1:-1]}]"))
    placed = text_layout(rows, key, text, collapse=True)
    solid = placed.where("_solid")
    first, last = solid.agg(F.min(key), F.max(key)).first()
    if first is None:
        return placed, 0, 0
    shown = F.substring(text, F.col("_skip") + 1, 1 << 30)
    edge = (solid.where((F.col(key) == F.lit(first)) | (F.col(key) == F.lit(last)))              # two texts
            .select(key, (F.col("_start") + F.col("_n") - F.length(F.regexp_replace(shown, f"^{WS_CLASS}+", ""))).alias("low"),
                    (F.col("_start") + F.length(F.regexp_replace(shown, f"{WS_CLASS}+$", ""))).alias("high")).collect())
    return placed, min(r.low for r in edge), max(r.high for r in edge)


def normalize_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text`` where the texts, concatenated in order, equal the
    normalised corpus."""
    placed, low, high = normalized_layout(docs, key, text)
    return placed.select(key, between(text, F.lit(low), F.lit(high)).alias(text))
