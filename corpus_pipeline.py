"""Documents to training pieces: language filter, near-duplicate removal, secret
masking, source mix, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it learns
what it needs from the rows it is given.  All but the last keep the columns of
``docs``, extra ones included.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import langid, mixing, secret_scan, simhash, unigram
from quarry.session import cut_lineage, ship_package

MIN_LANGUAGE_SCORE = 0.5
ORACLE_SQL = None        # tests/llm/test_pipeline.py holds the stages against direct computations


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language that is likelier
    than all others together."""
    ship_package(spark)
    found = langid.identify(docs, langid.train(docs), keep=tuple(docs.columns), names=("__lang", "__likely"))
    return found.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__likely") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the smallest
    id (null ids last, then by a hash of the text); of rows that repeat an id
    and a text, the first by their other columns."""
    ship_package(spark)
    key = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text")]
    names = ["__null", "__doc", "__hash"]
    keyed = docs.select(F.struct(*[k.alias(n) for k, n in zip(key, names, strict=True)]).alias("key"), "text")
    groups = simhash.near_duplicates(keyed, "key", "text")
    stays = groups.where("id = component").select("id.*").distinct()
    first = Window.partitionBy(*names).orderBy(F.to_json(F.struct(*[docs[c] for c in docs.columns if c != "text"])))
    return (docs.withColumns(dict(zip(names, key, strict=True))).join(stays, names)
            .withColumn("__place", F.row_number().over(first)).where("__place = 1").select(*docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets of every text; all documents stay, and ``n_chars``
    follows the masked text."""
    ship_package(spark)
    masked = secret_scan.mask_secrets(docs, secret_scan.train(docs))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else masked


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources meet their targets."""
    ship_package(spark)
    return mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of every text."""
    ship_package(spark)
    return unigram.encode(docs, unigram.load())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets),
          ("mixture", mixture), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
