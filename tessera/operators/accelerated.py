"""Accelerated bootstrap intervals of ratios of sums over any number of units.

The jackknife of a ratio needs no pass over pairs of units: leaving a unit out is the total less its own sums. Draws are sums
weighted by multiplicities. Neither the units nor their draws pass through the driver; what is left for the normal
distribution is one row a group.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ranks import running
from .splits import blocked_ratio


def acceleration(units: DataFrame, top: str, bottom: str, by: list[str] = ()) -> DataFrame:
    """by, theta, n, acceleration of sum(top) / sum(bottom) over units; 0 where all units weigh alike, null for fewer than two."""
    by = list(by)
    total = units.groupBy(*by).agg(F.sum(top).alias("_t"), F.sum(bottom).alias("_b"), F.count("*").alias("n"))
    own = units.select(*by, F.col(top).alias("_top"), F.col(bottom).alias("_bottom"))
    both = own.join(F.broadcast(total), by) if by else own.crossJoin(F.broadcast(total))
    left = both.withColumn("_left", F.try_divide(F.col("_t") - F.col("_top"), F.col("_b") - F.col("_bottom")))
    mean = left.groupBy(*by).agg(F.avg("_left").alias("_mean"))
    far = left.join(F.broadcast(mean), by) if by else left.crossJoin(F.broadcast(mean))
    d = F.col("_mean") - F.col("_left")
    out = far.groupBy(*by).agg(F.first(F.try_divide("_t", "_b")).alias("theta"), F.first("n").alias("n"), F.sum(d * d * d).alias("_cube"), F.sum(d * d).alias("_square"))
    a = F.when(F.col("n") > 1, F.coalesce(F.try_divide("_cube", 6 * F.pow("_square", F.lit(1.5))), F.lit(0.0)))
    return out.select(*by, "theta", "n", a.alias("acceleration"))


def shares_below(draws: DataFrame, points: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, draws, share: draws below theta, those equal to it by half. ``draws``: by, value; ``points``: by, theta."""
    by = list(by)
    both = draws.join(points.select(*by, "theta"), by) if by else draws.crossJoin(F.broadcast(points.select("theta")))
    v = F.col("value")
    return both.groupBy(*by).agg(F.count("*").alias("draws"), (F.avg((v < F.col("theta")).cast("double")) + F.avg((v == F.col("theta")).cast("double")) / 2).alias("share"))


def adjusted_levels(rows: DataFrame, level: float = 0.95) -> DataFrame:
    """``rows`` (acceleration, share) with low_level and high_level: the quantiles of the draws to read."""

    def adjust(batches):
        z = NormalDist()
        ends = [z.inv_cdf((1 - level) / 2), z.inv_cdf((1 + level) / 2)]
        for b in batches:
            out = []
            for a, p in zip(b.acceleration, b.share):
                if pd.isna(a) or pd.isna(p):
                    out.append((np.nan, np.nan))
                    continue
                shift = z.inv_cdf(min(1 - 1e-9, max(1e-9, p)))
                out.append(tuple(z.cdf(shift + (shift + e) / (1 - a * (shift + e))) for e in ends))
            low, high = zip(*out) if out else ((), ())
            yield b.assign(low_level=np.array(low, float), high_level=np.array(high, float))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(adjust, f"{shape}, low_level double, high_level double")


def quantiles_at(draws: DataFrame, levels: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by and the interpolated quantiles of ``value`` at each row's own levels. Running counts find the two neighbouring ranks."""
    seen = running(draws.groupBy(*by, "value").agg(F.count("*").alias("c")), list(by), "value", seen="c").select(*by, "value", "seen")
    both = seen.join(levels.select(*by, "draws", *names), by) if by else seen.crossJoin(F.broadcast(levels.select("draws", *names)))
    found = []
    for name in names:
        at = F.col(name) * (F.col("draws") - 1)
        value = lambda rank: F.min(F.when(F.col("seen") >= rank, F.col("value")))
        low, high, part = value(F.floor(at) + 1), value(F.least(F.floor(at) + 2, F.col("draws"))), F.first(at - F.floor(at))
        found.append((low + (high - low) * part).alias(f"{name}_value"))
    return both.groupBy(*by).agg(*found)


def accelerated_interval(units: DataFrame, weights: DataFrame, key: str, top: str, bottom: str, by: list[str] = (), level: float = 0.95) -> DataFrame:
    """by, theta, n, acceleration, draws, share, low, high.

    ``units``: key, by, top, bottom; ``weights``: draw, key, mult (every unit in every draw that it is in). A draw without
    any weight has no value and is left out of ``draws``. Bounds are null where a group has fewer than two units.
    """
    by = list(by)
    return interval_of_draws(units, blocked_ratio(units, weights, key, top, bottom, by), top, bottom, by, level)


def interval_of_draws(units: DataFrame, values: DataFrame, top: str, bottom: str, by: list[str] = (), level: float = 0.95) -> DataFrame:
    """``accelerated_interval`` from the draws' ``values`` (by, draw, value)."""
    by = list(by)
    point = stored(acceleration(units, top, bottom, by), "points")
    draws = stored(values.where("value is not null").select(*by, "value"), "values")
    rows = point.join(shares_below(draws, point, by), by) if by else point.crossJoin(F.broadcast(shares_below(draws, point)))
    rows = stored(adjusted_levels(rows, level), "adjusted")
    q = quantiles_at(draws, rows, by, ["low_level", "high_level"])
    out = rows.join(q, by, "left") if by else rows.crossJoin(F.broadcast(q))
    return out.select(*by, "theta", "n", "acceleration", "draws", "share", F.col("low_level_value").alias("low"), F.col("high_level_value").alias("high"))
