"""Mixing sources to target weights.

Words are summed per source, every source gets a target number of words, and
each document is emitted ``floor(rate)`` times plus one more time with
probability equal to the fraction, where rate = target / words of the source.
The extra copy is drawn from a hash of the seed and the id, so reruns and
recomputed tasks agree.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share ``share`` of all words.  A target stops at ``cap`` times its source's
words and the excess is shared again by weight.  In the order of
``cap * words / weight`` the stopped sources come first, so running sums over
the source table give the fixed point in one pass; the test for being stopped
is exact integer arithmetic.  The source table has one row per source, already
summed; it is the only thing ordered globally.

Defined results: null and empty texts have size 0 and take nothing; a null
source is a source; a null id draws like the empty string; rows that repeat an
id draw alike; a source without any word has target 0 and rate 1 (its empty
documents pass once); an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)      # 150 % of all words, as a fraction
CAP = 2             # no source is repeated more often than this
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: str, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from the id: 52 bits of an md5."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size",
                   weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
                   cap: int = CAP) -> DataFrame:
    """One row per source: ``source, source_size, target, rate``."""
    up, down = share
    per_source = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    rows = (per_source
            .withColumn("place", F.row_number().over(by_name))
            .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                               (F.col("place") - 1) % len(weights) + 1).cast("long"))
            .withColumn("all_size", F.sum("source_size").over(Window.partitionBy()))
            .withColumn("size_before", F.coalesce(F.sum("source_size").over(
                by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("weight_from", F.sum("weight").over(
                by_ratio.rowsBetween(0, Window.unboundedFollowing)))
            # both sides times ``down``: what is left of the budget against the cap
            .withColumn("left_over", up * F.col("all_size") - down * cap * F.col("size_before"))
            .withColumn("stopped", F.col("left_over") * F.col("weight")
                        > down * cap * F.col("source_size") * F.col("weight_from")))
    free = Window.partitionBy()
    open_size = F.sum(F.when(F.col("stopped"), F.col("source_size")).otherwise(0)).over(free)
    open_weight = F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(free)
    target = F.when(F.col("stopped"), (cap * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * (up * F.col("all_size") - down * cap * open_size)).cast("double")
        / (down * open_weight).cast("double"))
    return (rows.withColumn("target", target)
            .select("source", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                    .otherwise(F.lit(1.0)).alias("rate")))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """One row per document: its id, ``source, size, source_size, target,
    rate, copies, taken``.  The texts are read once, for their sizes; what the
    second pass and the sums need is a narrow table in the checkpoint folder."""
    sizes = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                    word_count(text_col).alias("size")))
    # written out, so the planner knows its size and broadcasts only below its limit
    targets = cut_lineage(source_targets(sizes, **shares)).withColumnRenamed("source", "of_source")
    whole = F.floor("rate")
    return (sizes.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
            .withColumn("copies", (whole + (draw("id", seed) < F.col("rate") - whole).cast("long")).cast("long"))
            .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """The mix itself: every document as often as its plan says, with exactly
    the columns of ``docs``.  Copies are made in place from the rate of the
    source, so the texts are not shuffled."""
    sizes = docs.select(F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    rates = cut_lineage(source_targets(sizes, **shares).select(
        F.struct(F.col("source").alias("s"), F.col("rate").alias("r")).alias("__mix")))
    whole = F.floor("__mix.r")
    copies = (whole + (draw(id_col, seed) < F.col("__mix.r") - whole).cast("int")).cast("int")
    return (docs.join(rates, docs[source_col].eqNullSafe(F.col("__mix.s")))
            .withColumn("__copy", F.explode(F.sequence(F.lit(0), copies)))
            .where(F.col("__copy") > 0)
            .select(*[docs[c] for c in docs.columns]))
