"""Driver tables (parquet) with explicit column pruning left to Catalyst."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# text-heavy tables whose per-row work (regex, chunking, embedding) dominates
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")
# how many partitions a caller wants text tables dealt to (unset: as scanned)
PARTITIONS_CONF = "spark.quarry.textPartitions"


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan a driver table (only ``columns`` when given).  Parallelism is the
    scan's own (``spark.sql.files.maxPartitionBytes``).  A caller whose text
    tables are files of one large row group, which cannot be split, may set
    ``spark.quarry.textPartitions`` to deal their rows out after the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    wanted = spark.conf.get(PARTITIONS_CONF, None)
    return df.repartition(int(wanted)) if wanted and name in TEXT_TABLES else df


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl table replaces live fetching: one row per fetch, with its HTML."""
    return table(spark, sf_dir, "pages", ["page_id", "url", "html"])


def question_key(conv: str = "conv_id", turn: str = "turn") -> Column:
    """Key of a message: conversation and turn, whatever their size."""
    return F.concat_ws(":", F.col(conv).cast("string"), F.col(turn).cast("string"))


def questions_from_conversations(conversations: DataFrame) -> DataFrame:
    """User turns as questions: ``q_id, conv_id, turn, question``."""
    return (conversations.where(F.col("role") == "user")
            .select(question_key().alias("q_id"), "conv_id", "turn", F.col("text").alias("question")))
