"""A corpus in global order, written once.

Texts are range-partitioned by key, sorted inside their range and written with
the number of the range and what the range alone tells: each text's place in it
and the character before it.  One row per range (its length, how it ends) is
scanned for the carries between ranges and joined by range number; that table has
as many rows as the write had tasks, is written as well, and so is broadcast only
below the planner's limit.  Every position then follows from reading the layout:
no text is joined back by key or shuffled again.

The written range numbers make recomputed tasks agree.  Any orderable key type
works; keys are unique and not null.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import cut_lineage

ADDED = [T.StructField("_range", T.IntegerType()), T.StructField("_off", T.LongType()), T.StructField("_n", T.LongType()),
         T.StructField("_drop", T.BooleanType()), T.StructField("_first", T.BooleanType()), T.StructField("_starts", T.BooleanType()),
         T.StructField("_ends", T.BooleanType())]


def _placing(collapse: bool):
    """(key, text) rows of one range, in order, with the columns of ``ADDED``:
    characters before the text in its range and in it, whether its first line end
    goes because the text before ends in one, whether it is the range's first text
    that is not empty, and whether it starts and ends with a line end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        total, before = 0, None                          # None: no text that is not empty yet
        for b in batches:
            texts = b.column(1)
            n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            starts, ends = (f(texts, "\n").to_numpy(zero_copy_only=False).astype(bool) for f in (pc.starts_with, pc.ends_with))
            some = np.flatnonzero(n)
            last = np.full(len(n), -1)                   # the nearest text before that is not empty
            inner = some[some + 1 < len(n)]
            last[inner + 1] = inner
            last = np.maximum.accumulate(last)
            ended = np.where(last >= 0, ends[last], bool(before))
            first = (n > 0) & (last < 0) & (before is None)
            drop = starts & ended & collapse
            n = n - drop
            off = total + np.cumsum(n) - n
            total += int(n.sum())
            if len(some):
                before = bool(ends[some[-1]])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *map(pa.array, (np.full(len(n), task, np.int32), off, n, drop, first, starts, ends))],
                names=[*b.schema.names, *[f.name for f in ADDED]])
    return run


def text_layout(rows: DataFrame, key: str, text: str, collapse: bool = False) -> DataFrame:
    """``rows`` (key, text, further columns) in order, with ``_start`` (characters
    of all texts before) and ``_n``; the text's first ``_skip`` characters do not
    count.  With ``collapse`` a text that starts with a line end loses it where the
    nearest text before that is not empty ends in one; without, ``_skip`` is 0."""
    more = [c for c in rows.columns if c not in (key, text)]
    frame = rows.select(key, F.coalesce(text, F.lit("")).alias(text), *more).repartitionByRange(key).sortWithinPartitions(key)
    placed = cut_lineage(frame.mapInArrow(_placing(collapse), T.StructType([*frame.schema.fields, *ADDED])))
    ranges = placed.groupBy("_range").agg(
        F.sum("_n").alias("_t"), F.max(F.col("_first") & F.col("_starts")).alias("_opens"),
        F.max_by("_ends", F.when(F.col("_n") + F.col("_drop").cast("int") > 0, F.col(key))).alias("_closes"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)       # one row per range
    carry = ranges.withColumn("_cut", (F.lit(collapse) & F.col("_opens") & F.coalesce(F.last("_closes", ignorenulls=True).over(before), F.lit(False)))
                              .cast("int"))
    carry = cut_lineage(carry.select("_range", "_cut", F.coalesce(F.sum(F.col("_t") - F.col("_cut")).over(before), F.lit(0)).alias("_base")))
    out = placed.join(carry, "_range")
    mine = F.when(F.col("_first"), F.col("_cut")).otherwise(0)           # the range's first line end goes
    return out.select(key, text, *more, (F.col("_drop").cast("int") + mine).alias("_skip"),
                      (F.col("_base") + F.col("_off") - F.when((F.col("_off") > 0), F.col("_cut")).otherwise(0)).alias("_start"),
                      (F.col("_n") - mine).alias("_n"))


def between(text: str, low: Column, high: Column) -> Column:
    """The part of a layout row's text whose corpus positions are in [low, high)."""
    begin = F.least(F.greatest(low - F.col("_start"), F.lit(0)), F.col("_n"))
    end = F.greatest(F.least(high - F.col("_start"), F.col("_n")), begin)
    return F.substring(text, (F.col("_skip") + begin + 1).cast("int"), (end - begin).cast("int"))
