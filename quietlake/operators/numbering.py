"""Consecutive numbers over a whole table without a task that sorts all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shuffle_partitions, written

_LOW = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, name: str = "nth") -> DataFrame:
    """``rows`` with a column ``name``: 1, 2, ... in order of ``order`` within each value of ``by``.

    Ranges of (by, order) are sorted, and written with each row's range and place in it, so
    counts and rows come from the same ranges; the counts of the ranges before are added.
    Nulls come first, and ties take an order of their own; an empty table stays empty.
    """
    by = by or []
    n = shuffle_partitions(rows.sparkSession)
    ranged = rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    stored = written(ranged.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit(_LOW))), "ranges")
    counts = stored.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__low"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    # one row per range and value of ``by``; without ``by`` the ranges alone, whose number is a setting
    before = counts.select(F.col("__part").alias("__of"), *own, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__low") + 1).alias("__move"))
    same = F.col("__part") == F.col("__of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    out = stored.join(before if by else F.broadcast(before), same)
    return out.select(*rows.columns, (F.col("__at") + F.col("__move")).alias(name))
