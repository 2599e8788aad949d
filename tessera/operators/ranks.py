"""Row numbers and running values over groups of any size: ranges of a group, not whole groups, are sorted by a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Ranges into which a group is cut for running sums.
BUCKETS = 64


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with ``name``: the row number from 1 in ``order`` within ``by`` (columns without nulls).

    Rows are dealt in ranges of (by, order) and written once in that order; a range's place in its group comes from
    the counts of the ranges before it. So neither a large group nor one without keys is sorted by a single task.
    """
    columns = rows.columns
    keys = [*by, *order]
    if not keys:
        raise ValueError("an order is needed")
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed, "ranges")
    ranges = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "_part", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_base"))
    return placed.join(ranges, [*by, "_part"]).select(*columns, (F.col("_at") - F.col("_base") + 1).alias(name))


def ranged(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rows`` with _range: one of BUCKETS ranges of ``order`` of about equal size within ``by``."""
    levels = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    cuts = rows.groupBy(*by).agg(F.percentile_approx(order, levels, F.lit(20 * BUCKETS)).alias("_cuts"))
    every = rows.join(F.broadcast(cuts), by) if by else rows.crossJoin(F.broadcast(cuts))
    return every.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")


def running(rows: DataFrame, by: list[str], order: str = "score", **sums: str) -> DataFrame:
    """``rows`` with running sums (name=column) by rising ``order`` within ``by``, and their _range.

    Sums run within a range, and the totals of the ranges below are added. ``rows`` are written once, as cuts, totals and sums
    each read them; cuts and totals are broadcast: a row, or BUCKETS, of each group.
    """
    every = ranged(stored(rows, "steps"), by, order)
    totals = every.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(below), F.lit(0)).alias(f"_t_{n}") for n in sums])
    inner = Window.partitionBy(*by, "_range").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.select("*", *[F.sum(c).over(inner).alias(f"_s_{n}") for n, c in sums.items()])
    return every.join(F.broadcast(totals), [*by, "_range"]).select(*rows.columns, "_range", *[(F.col(f"_s_{n}") + F.col(f"_t_{n}")).alias(n) for n in sums])


def highest_so_far(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """``rows`` (with a _range of ``order``) with ``name``: the largest ``value`` of the rows up to each in rising ``order``."""
    top = rows.groupBy(*by, "_range").agg(F.max(value).alias("_top"))
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select(*by, "_range", F.max("_top").over(below).alias("_below"))
    inner = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_own", F.max(value).over(inner)).join(top, [*by, "_range"]).select(*rows.columns, F.greatest("_own", "_below").alias(name))
