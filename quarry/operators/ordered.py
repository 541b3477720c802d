"""Scans in a global order without pulling rows into one task.

A single ``Window.orderBy`` (no partition) moves every row to one task.  Here a
narrow frame (the key and what is summed, no texts) is range-partitioned by the
key, written out with the number of each row's range, and scanned range by
range; every range is then shifted by the totals of the ranges before it.  The
written range numbers make recomputed tasks agree.  Any orderable key type
works.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage

RANGE = "_range"


def ordered_scan(df: DataFrame, key: str, sums: dict[str, str] | None = None,
                 prev_non_null: dict[str, str] | None = None,
                 group_cols: list[str] | tuple[str, ...] = (), totals: bool = False) -> DataFrame:
    """For each row, in ``key`` order within its group (key unique per group):

    * ``sums[out] = col``: sum of ``col`` over all earlier rows (0 if none);
      with ``totals`` also ``out + "_total"``, the sum over the whole group;
    * ``prev_non_null[out] = col``: ``col`` of the nearest earlier row where it
      is not null (null if none).

    The table of range totals has one row per group and range; it is written
    out, so the planner knows its size and broadcasts it only below its limit.
    """
    sums = sums or {}
    prev_non_null = prev_non_null or {}
    g = list(group_cols)
    b = cut_lineage(df.repartitionByRange(key).withColumn(RANGE, F.spark_partition_id()))
    aggs = [F.sum(c).alias(f"_t_{o}") for o, c in sums.items()]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(key))).alias(f"_l_{o}")
             for o, c in prev_non_null.items()]
    per_range = b.groupBy(*g, RANGE).agg(*aggs)
    before = Window.partitionBy(*g).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    carry = cut_lineage(per_range.select(
        *g, RANGE,
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_c_{o}") for o in sums],
        *[F.coalesce(F.sum(f"_t_{o}").over(whole), F.lit(0)).alias(f"{o}_total") for o in sums if totals],
        *[F.last(f"_l_{o}", ignorenulls=True).over(before).alias(f"_p_{o}") for o in prev_non_null]))
    w = Window.partitionBy(*g, RANGE).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = b.join(carry, g + [RANGE])
    for o, c in sums.items():
        out = out.withColumn(o, F.col(f"_c_{o}") + F.coalesce(F.sum(c).over(w), F.lit(0)))
    for o, c in prev_non_null.items():
        out = out.withColumn(o, F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_p_{o}")))
    return out.drop(RANGE, *[f"_c_{o}" for o in sums], *[f"_p_{o}" for o in prev_non_null])
