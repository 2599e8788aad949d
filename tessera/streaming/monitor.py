"""Coverage monitors over streams of scored objects: an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage_windows(rows: DataFrame, thresholds: DataFrame, every: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window, class, n, covered over event time. ``rows``: ts, class, score; works on batches and on streams.

    Late rows are kept until the watermark passes their window.
    """
    known = rows.withWatermark("ts", late).join(F.broadcast(thresholds.select("class", "q")), "class")
    span = F.window("ts", every, slide) if slide else F.window("ts", every)
    return known.groupBy(span.alias("window"), "class").agg(F.count("*").alias("n"), F.avg((F.col("score") <= F.col("q")).cast("double")).alias("covered"))


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """window, user_id, n: bursts of events of a user."""
    return rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n"))


def first_seen(rows: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key, forgetting keys behind the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
