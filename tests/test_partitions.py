"""SURVEY §5.4: order-sensitive operators give the same result whatever the
input partitioning and the number of key ranges of the ordered scans."""
from pyspark.sql import functions as F

from quarry.operators.docs import concat_ordered
from quarry.plans.train import split_parts, training_blocks

SF = "/root/testdata/sf0.001"


def _collect(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_split_and_blocks_are_partition_independent(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts, ranges in ((1, 1), (17, 13)):
            spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
            d = docs.repartition(parts)
            blocks = training_blocks(d, vocab_size=1000)
            results.append((_collect(split_parts(d), "split", "doc_id"),
                            _collect(blocks.select("split", "block_id", F.array_join("input_ids", " ")), "split", "block_id")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    assert len(results[0][1]) > 0


def test_ordered_concat_is_partition_independent(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    outs = [_collect(concat_ordered(conv.repartition(n), "conv_id", "turn", parts_per_range=per), "conv_id")
            for n, per in ((1, 1024), (4, 1), (17, 3))]
    assert outs[0] == outs[1] == outs[2]
