"""Simulated scenes, calibration studies and planning by simulation. Streams are seeded per replication, so runs may be split at will."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import running
from .thresholds import max_rank

# Fixed values of the simulated populations: scene sizes, their shares, and the seed.
SIZES, SHARES, SEED = (1, 8, 64), (0.6, 0.3, 0.1), 20260928


def conditions() -> list[dict]:
    """Calibration sizes x regimes with their size effects x within-scene correlations."""
    out = []
    for n in (50, 200, 1000):
        for regime, effects in (("constant8", (0.0,)), ("heterogeneous", (-0.75, 0.0, 0.75))):
            for gamma in effects:
                for rho in (0.0, 0.5, 0.9):
                    out.append({"condition": len(out), "n_cal": n, "regime": regime, "gamma": gamma, "rho": rho, "bound": 8 if regime == "constant8" else 64})
    return out


def scenes(condition: dict, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Scene index and log-normal score of each object.

    The law: sizes are 8, or drawn from SIZES with SHARES; with z the standardised log size, a log score is
    gamma z + sqrt(rho) (scene effect) + sqrt(1 - rho) (own effect). Sizes, scene effects and own effects are drawn in that order.
    """
    if condition["regime"] == "constant8":
        sizes, pull = np.array([8]), np.array([0.0])
        kind = np.zeros(count, int)
    else:
        sizes, logs, p = np.array(SIZES), np.log(SIZES), np.array(SHARES)
        pull = logs - p @ logs
        pull = pull / np.sqrt(p @ pull**2)
        kind = rng.choice(len(sizes), count, p=p)
    scene = np.repeat(np.arange(count), sizes[kind])
    effects = rng.standard_normal(count), rng.standard_normal(len(scene))
    rho = condition["rho"]
    logs = (condition["gamma"] * pull[kind] + math.sqrt(rho) * effects[0])[scene] + math.sqrt(1 - rho) * effects[1]
    return scene, np.exp(logs)


def simulated(spark: SparkSession, replications: int, chosen: list[int] | None = None, alpha: float = 0.1) -> DataFrame:
    """condition, replication, method, q, cov_scene, cov_object: thresholds calibrated and evaluated on fresh scenes."""
    table = [c for c in conditions() if chosen is None or c["condition"] in chosen]

    def run(batches):
        for b in batches:
            rows = []
            for i in b.id:
                c, rep = table[int(i) % len(table)], int(i) // len(table)
                stream = lambda s, c=c, rep=rep: np.random.default_rng(np.random.SeedSequence([SEED, c["condition"], rep, s]))
                cal_scene, cal = scenes(c, c["n_cal"], stream(0))
                ev_scene, ev = scenes(c, 500, stream(1))
                for method, q in thresholds(cal_scene, cal, alpha, c["bound"]).items():
                    hit = ev <= q
                    m = np.bincount(ev_scene)
                    rows.append((c["condition"], rep, method, q, float((np.bincount(ev_scene, hit) / m).mean()), float(hit.mean())))
            yield pd.DataFrame(rows, columns=["condition", "replication", "method", "q", "cov_scene", "cov_object"])

    return spark.range(replications * len(table)).mapInPandas(run, "condition int, replication int, method string, q double, cov_scene double, cov_object double")


def thresholds(scene: np.ndarray, score: np.ndarray, alpha: float, bound: int) -> dict[str, float]:
    """The four scene-aware thresholds of one calibration set, in memory."""
    ordered, sizes = np.sort(score), np.bincount(scene)
    worst = np.zeros(len(sizes))
    np.maximum.at(worst, scene, score)  # scores are positive

    def split(values: np.ndarray) -> float:
        above = math.floor((len(values) + 1) * alpha)  # of n + 1 places, those that may lie above
        return math.inf if above == 0 else float(np.sort(values)[-above])

    order = np.argsort(score, kind="stable")
    mass = np.cumsum(1.0 / sizes[scene[order]])
    enough = np.flatnonzero(mass >= (1 - alpha) * (len(sizes) + 1) - 1e-9)
    spare = alpha * len(score) - (1 - alpha) * bound  # objects that may lie above, where any number is allowed
    crc = math.inf if spare < -1e-9 else float(np.append(0.0, ordered)[max(0, len(score) - math.floor(spare + 1e-9))])
    return {"pooled": split(score), "hcp": float(score[order[enough[0]]]) if len(enough) else math.inf, "scene_max": split(worst), "crc_object": crc}


def familywise_errors(spark: SparkSession, risks: list[list[float]], shares: list[float], n: int, beta: float, delta: float, draws: int, seed: int = 1) -> DataFrame:
    """draw, errors: false certificates in multinomial samples of n pseudo-scenes whose mean risk is beta or more.

    ``risks``: candidate x pseudo-scene; each candidate is tested at delta / candidates.
    """
    table, p = np.asarray(risks, float), np.asarray(shares, float)
    level = delta / len(table)

    def run(batches):
        for b in batches:
            rows = []
            for d in b.id:
                w = np.random.default_rng(np.random.SeedSequence([seed, int(d)])).multinomial(n, p)
                mean = table @ w / n
                var = np.maximum(0.0, (table**2) @ w - n * mean**2) / (n - 1)
                a, gap = 7 / (3 * (n - 1)), np.maximum(0.0, beta - mean)
                b_ = np.sqrt(2 * var / n)
                t = (np.sqrt(b_ * b_ + 4 * a * gap) - b_) / (2 * a)
                passed = (gap > 0) & (np.minimum(1, 2 * np.exp(-t * t)) <= level)
                rows.append((int(d), int((passed & (table @ p >= beta)).any())))
            yield pd.DataFrame(rows, columns=["draw", "errors"])

    return spark.range(draws).mapInPandas(run, "draw long, errors int")


def matched_level(residuals: DataFrame, target: float | DataFrame, coords: list[str], by: list[str], least: float = 1e-6) -> DataFrame:
    """by, alpha, coverage, n: the nominal level at which the joint box over coordinates covers ``target`` of the evaluation rows.

    ``residuals``: by, role ('cal' or 'eval') and coordinates; ``target``: a share, or a table (by, target). An evaluation
    row is covered from the rank on that its worst coordinate needs, so coverage is a step function of the rank k, and
    counts of needed ranks replace any search over rows. The level is the supremum of those that cover the target,
    within least and 1 - least; at k above the calibration size everything is covered.
    """
    by, c = list(by), len(coords)
    cal, ev = residuals.where("role = 'cal'"), residuals.where("role = 'eval'").withColumn("_id", F.monotonically_increasing_id())
    size = cal.groupBy(*by).agg(F.count("*").alias("n"))
    need = max_rank(cal, ev.select("_id", *by, *coords), coords, ["_id"], by).join(F.broadcast(size), by)
    need = need.select(*by, (F.round(F.col("score") * F.col("n")) + 1).cast("long").alias("need"))
    seen = running(need.groupBy(*by, "need").agg(F.count("*").alias("c")), by, "need", seen="c")
    total = ev.groupBy(*by).agg(F.count("*").alias("rows")).join(size, by)
    goal = total.withColumn("target", F.lit(float(target))) if not isinstance(target, DataFrame) else total.join(target.select(*by, "target"), by)
    rows = seen.select(*by, "need", "seen").join(F.broadcast(goal), by)
    rank = lambda a: (F.col("n") + 1) - F.floor((F.col("n") + 1) * a / c)
    share = F.col("seen") / F.col("rows")
    at = lambda k: F.when(k > F.col("n"), F.lit(1.0)).otherwise(F.coalesce(F.max(F.when((F.col("need") <= k) & (F.col("need") <= F.col("n")), share)), F.lit(0.0)))
    first = F.min(F.when((share >= F.col("target")) & (F.col("need") <= F.col("n")), F.col("need")))
    best = rows.groupBy(*by, "n", "rows", "target").agg(first.alias("_first"), at(rank(F.lit(least))).alias("cov_low"), at(rank(F.lit(1 - least))).alias("cov_high"))
    k = F.coalesce("_first", F.col("n") + 1)
    top = c * (F.col("n") + 2 - k) / (F.col("n") + 1)  # every smaller level has the rank k or more
    alpha = F.when(F.col("cov_low") <= F.col("target"), F.lit(least)).when(F.col("cov_high") >= F.col("target"), F.lit(1 - least)).otherwise(top)
    # the rank just below the supremum is k
    chosen = F.when(F.col("cov_low") <= F.col("target"), rank(F.lit(least))).when(F.col("cov_high") >= F.col("target"), rank(F.lit(1 - least))).otherwise(k)
    best = best.select(*by, alpha.alias("alpha"), chosen.alias("_rank"))
    out = rows.join(F.broadcast(best), by).groupBy(*by, "n", "alpha", "_rank").agg(at(F.col("_rank")).alias("coverage"))
    return out.select(*by, "alpha", "coverage", "n")


def normal_tail(x):
    """P(Z > x) of a standard normal Column."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    # The rational approximation of the complementary error function (relative error below 1.2e-7).
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for v in reversed(c[:-1]):
        poly = F.lit(v) + t * poly
    tail = t * F.exp(-z * z + poly) / 2
    return F.when(x >= 0, tail).otherwise(1 - tail)
