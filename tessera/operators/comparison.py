"""Two certificates of the same matched pairs side by side: a grown polygon by its margin, and a distance ball."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import grown_readout

#: What a class's threshold says: there is none, it is infinite, or it is finite.
MISSING, OPEN, FINITE = "missing_class", "no_finite_certificate", "finite"


def _checked(q: Column) -> Column:
    bad = F.isnan(q) | (q < 0)
    return F.when(bad, F.raise_error(F.lit("a threshold is negative or not a number")).cast("double")).otherwise(q)


def status(q: Column) -> Column:
    return F.when(q.isNull(), MISSING).when(q == math.inf, OPEN).otherwise(FINITE)


def common_events(rows: DataFrame, thresholds: DataFrame, by: str = "class") -> DataFrame:
    """``rows`` (by, pred, gt, margin, distance) with both thresholds, events and states.

    ``thresholds``: by, margin_q, ball_q, one row a class (a null class too). Added: margin_q, ball_q; margin_holds and
    ball_holds (the score's own event), grown_holds (the grown polygon holds the true corners within its tolerance; an
    infinite threshold holds all); margin_status and ball_status. Where a threshold is missing its events are null. Rows
    are neither dropped nor matched anew; a null class meets the threshold of the null class. NaN or a negative
    threshold is an error.
    """
    t = thresholds.select(F.col(by).alias("_by"), _checked(F.col("margin_q")).alias("margin_q"), _checked(F.col("ball_q")).alias("ball_q"))
    both = rows.join(t, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    m, b = F.col("margin_q"), F.col("ball_q")
    grown = grown_readout(F.col("pred"), F.col("gt"), F.coalesce(m, F.lit(math.inf)))["covered"]
    return both.select(
        "*", (F.col("margin") <= m).alias("margin_holds"), F.when(m.isNotNull(), grown).alias("grown_holds"), (F.col("distance") <= b).alias("ball_holds"), status(m).alias("margin_status"), status(b).alias("ball_status"),
    )


def event_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """by, both states, pairs, and how often each event holds and the two disagree; null where a threshold is missing."""
    n = lambda c: F.when(F.count(c) > 0, F.sum(F.col(c).cast("long"))).alias(c)
    differ = F.col("margin_holds") != F.col("ball_holds")
    return events.groupBy(*by, "margin_status", "ball_status").agg(F.count("*").alias("pairs"), n("margin_holds"), n("grown_holds"), n("ball_holds"), F.count_if(differ).alias("disagree"))
