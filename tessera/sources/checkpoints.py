"""Resumable draw tables: a block of draws is a partition, written whole or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def committed(spark: SparkSession, path: str) -> dict[int, int]:
    """Blocks that are there, with the draws each holds."""
    try:
        return {r.block: r.n for r in spark.read.parquet(path).groupBy("block").agg(F.countDistinct("draw").alias("n")).collect()}
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return {}
        raise


def run_blocks(spark: SparkSession, path: str, draws: int, per_block: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Make the missing blocks with ``make`` (a frame of draws to a frame with draw), and read all.

    A block that broke off or grew is made again and replaces what is there; draws are seeded, so the table is the
    same however often it was resumed.
    """
    have = committed(spark, path)
    for block in range((draws + per_block - 1) // per_block):
        first, last = block * per_block, min(draws, (block + 1) * per_block)
        if have.get(block) != last - first:
            ids = spark.range(first, last).withColumnRenamed("id", "draw")
            made = make(ids).withColumn("block", F.lit(block))
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(path)
    return spark.read.parquet(path)


def problems(table: DataFrame, draws: int) -> DataFrame:
    """One row: draws missing, and rows repeated."""
    n = table.agg(F.countDistinct("draw").alias("have"), F.count("*").alias("rows"), F.countDistinct(*[c for c in table.columns if c != "block"]).alias("different"))
    return n.select((F.lit(draws) - F.col("have")).alias("missing"), (F.col("rows") - F.col("different")).alias("repeated"))
