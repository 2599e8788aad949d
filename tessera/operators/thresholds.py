"""Conformal thresholds as ordered-set aggregates over scores grouped by any keys.

Thresholds are computed on counts per distinct score (partial aggregation before the shuffle), then
one running sum per group finds the first score whose mass reaches the target.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ranks import running

INF = float("inf")
METHODS = ("pooled", "hcp", "crc_object", "scene_max")
SLACK = 1e-9
#: Least common multiple of 1 to 22.
PARTS = 232_792_560
#: Rows from which on a value is looked up by broadcast.
OFTEN = 10_000


class CalibrationError(ValueError):
    """Arguments that no threshold exists for."""


def check_alpha(alpha: float) -> float:
    alpha = float(alpha)
    if not 0 < alpha < 1:
        raise CalibrationError("alpha must lie between 0 and 1")
    return alpha


def conformal_rank(n: Column, alpha: Column | float) -> Column:
    """(n + 1) - floor((n + 1) * alpha)."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return (n + 1) - F.floor((n + 1) * a)


def _by_ranks(scores: DataFrame, by: list[str], ranks: list[Column]) -> DataFrame:
    """by, n, q0, q1, ...: the scores of given ranks (Columns over n); +inf above n, -inf at 0 or less. One pass serves all."""
    counts = scores.groupBy(*by, "score").agg(F.count("*").alias("c"))
    total = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    ranked = running(counts, by, seen="c")
    joined = ranked.join(total, by) if by else ranked.crossJoin(F.broadcast(total))
    out = joined.groupBy(*by, "n").agg(*[F.min(F.when(F.col("seen") >= k, F.col("score"))).alias(f"q{i}") for i, k in enumerate(ranks)])
    bounded = lambda i, k: F.when(k > F.col("n"), F.lit(INF)).when(k <= 0, F.lit(-INF)).otherwise(F.col(f"q{i}")).alias(f"q{i}")
    return out.select(*by, "n", *[bounded(i, k) for i, k in enumerate(ranks)])


def _by_rank(scores: DataFrame, by: list[str], rank: Column) -> DataFrame:
    """by, q, n: the score of the given rank."""
    return _by_ranks(scores, by, [rank]).select(*by, F.col("q0").alias("q"), "n")


def pooled(scores: DataFrame, alpha: float, by: list[str] = ()) -> DataFrame:
    """Split-conformal threshold over all objects of a group. ``scores`` holds by, scene and score."""
    check_alpha(alpha)
    return _by_rank(scores, list(by), conformal_rank(F.col("n"), alpha))


def scene_max(scores: DataFrame, alpha: float, by: list[str] = ()) -> DataFrame:
    """Split-conformal threshold over each scene's largest score."""
    check_alpha(alpha)
    most = scores.groupBy(*by, "scene").agg(F.max("score").alias("score"))
    return _by_rank(most, list(by), conformal_rank(F.col("n"), alpha))


def _hcp_levels(scores: DataFrame, alphas: list[float], by: list[str]) -> DataFrame:
    """by, n, q0, q1, ...: hierarchical thresholds of several levels from one running mass."""
    sizes = scores.groupBy(*by, "scene").agg(F.count("*").alias("m"))
    sized = scores.groupBy(*by, "scene", "score").agg(F.count("*").alias("c")).join(sizes, [*by, "scene"])
    mass = sized.groupBy(*by, "score").agg(
        F.sum(F.col("c") * F.expr(f"{PARTS}L div m").cast("decimal(38,0)")).cast("decimal(38,0)").alias("whole"), F.sum(F.col("c") / F.col("m")).alias("mass")
    )
    total = sizes.groupBy(*by).agg(F.count("*").alias("scenes"), F.sum("m").alias("n"), F.max(F.lit(PARTS) % F.col("m") != 0).alias("odd"))
    seen = running(mass, by, seen="mass", seen_whole="whole")
    joined = seen.join(total, by) if by else seen.crossJoin(F.broadcast(total))

    def first(alpha: float) -> Column:
        ratio = Fraction(repr(alpha))
        need = (F.lit(PARTS * (ratio.denominator - ratio.numerator)).cast("decimal(38,0)") * (F.col("scenes") + 1).cast("decimal(20,0)")).cast("decimal(38,0)")
        whole = (F.col("seen_whole") * F.lit(ratio.denominator)).cast("decimal(38,0)") >= need
        reached = F.when(F.col("odd"), F.col("seen") >= (1 - alpha) * (F.col("scenes") + 1) - SLACK).otherwise(whole)
        return F.coalesce(F.min(F.when(reached, F.col("score"))), F.lit(INF))

    return joined.groupBy(*by).agg(F.first("n").alias("n"), *[first(a).alias(f"q{i}") for i, a in enumerate(alphas)])


def hcp(scores: DataFrame, alpha: float, by: list[str] = ()) -> DataFrame:
    """Hierarchical threshold: each scene has mass 1/(K+1), split evenly over its objects, and so has +inf.

    Masses are integers, in parts of PARTS, where every scene size of the group divides it (all up to 22 do) and the
    comparison is exact; elsewhere the running double sum may fall short of the target by SLACK.
    """
    return _hcp_levels(scores, [check_alpha(alpha)], list(by)).select(*by, F.col("q0").alias("q"), "n")


def crc_object(scores: DataFrame, alpha: float, bound: int, by: list[str] = (), floor: str = "-inf") -> DataFrame:
    """Smallest q with #{score > q} <= alpha * N - (1 - alpha) * bound; a scene above ``bound`` objects raises.

    ``floor``: what stands where no score is needed, '-inf' or '0'.
    """
    alpha, by = check_alpha(alpha), list(by)
    if int(bound) < 1:
        raise CalibrationError("the scene-size bound must be 1 or more")
    sizes = scores.groupBy(*by, "scene").agg(F.count("*").alias("m")).groupBy(*by).agg(F.max("m").alias("most"))
    budget = F.lit(alpha) * F.col("n") - (1 - alpha) * bound
    rank = F.when(budget < -SLACK, F.col("n") + 1).otherwise(F.col("n") - F.least(F.floor(budget + SLACK), F.col("n")))
    out = _by_rank(scores, by, rank)
    out = out.join(sizes, by) if by else out.crossJoin(F.broadcast(sizes))
    q = F.when(F.col("most") > bound, F.raise_error(F.lit("a scene holds more objects than the bound")).cast("double")).otherwise(F.col("q"))
    if floor == "0":
        q = F.when(q == -INF, F.lit(0.0)).otherwise(q)
    return out.select(*by, q.alias("q"), "n")


def crc_adaptive(scores: DataFrame, alpha: float, deployed: DataFrame, by: list[str] = ()) -> DataFrame:
    """``deployed`` (by, scene, d) with the threshold q of each scene's own count d.

    The needed ranks are few: thresholds are looked up per distinct d.
    """
    alpha, by = check_alpha(alpha), list(by)
    counts = scores.groupBy(*by, "score").agg(F.count("*").alias("c"))
    total = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    ranked = running(counts, by, seen="c")
    wanted = deployed.select(*by, "d").distinct()
    wanted = wanted.join(total, by) if by else wanted.crossJoin(F.broadcast(total))
    budget = F.lit(alpha) * F.col("n") - (1 - alpha) * F.col("d")
    k = F.col("n") - F.least(F.floor(budget + SLACK), F.col("n"))
    wanted = wanted.select(*by, "d", F.when(budget < -SLACK, F.lit(None)).otherwise(k).alias("_k"))
    # each wanted rank goes to the range that reaches it, and there to the first score that does
    tops = ranked.groupBy(*by, "_range").agg(F.max("seen").alias("top")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("top", "_range"))).alias("tops"))
    asked = wanted.where("_k >= 1")
    asked = asked.join(tops, by) if by else asked.crossJoin(F.broadcast(tops))
    asked = asked.select(*by, F.get(F.filter("tops", lambda t: t["top"] >= F.col("_k")), F.lit(0))["_range"].alias("_range"), F.col("_k").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("score"), "d", "_k")
    every = asked.unionByName(ranked.select(*by, "_range", F.col("seen").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.col("score").cast("double").alias("score")), allowMissingColumns=True)
    on = Window.partitionBy(*by, "_range").orderBy("_at", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    hits = every.withColumn("found", F.first("score", ignorenulls=True).over(on)).where("_kind = 0").select(*by, "d", F.col("found").alias("score"))
    found = wanted.join(hits, [*by, "d"], "left").select(*by, "d", "_k", "score")
    q = F.when(F.col("_k").isNull(), F.lit(INF)).when(F.col("_k") <= 0, F.lit(-INF)).otherwise(F.col("score"))
    return deployed.join(found.select(*by, "d", q.alias("q")), [*by, "d"])


def class_thresholds(scores: DataFrame, alpha: float, method: str, bound: int | None = None, by: str = "class") -> DataFrame:
    """class, q_hat, n_scenes, n_objects, status for each class. ``scores`` holds class, scene and score."""
    if method not in METHODS:
        raise CalibrationError(f"unknown method {method!r}; choose from {sorted(METHODS)}")
    check_alpha(alpha)
    if method == "crc_object":
        if bound is None:
            raise CalibrationError("crc_object needs the scene-size bound")
        q = crc_object(scores, alpha, bound, [by])
    else:
        q = {"pooled": pooled, "hcp": hcp, "scene_max": scene_max}[method](scores, alpha, [by])
    support = scores.groupBy(by, "scene").agg(F.count("*").alias("m")).groupBy(by).agg(F.count("*").alias("n_scenes"), F.sum("m").alias("n_objects"))
    return q.select(by, F.col("q").alias("q_hat")).join(support, by).withColumn("status", F.when(F.col("q_hat") < INF, "certified").otherwise("support_floor"))


def weighted(scores: DataFrame, alpha: float, by: list[str] = (), hierarchical: bool = False) -> DataFrame:
    """by, q of scores whose scenes have an integer multiplicity ``mult`` (copies of the scene)."""
    alpha, by = check_alpha(alpha), list(by)
    rows = scores.where("mult > 0")
    if not hierarchical:
        mass = rows.groupBy(*by, "score").agg(F.sum("mult").cast("double").alias("mass"))
        total = mass.groupBy(*by).agg(F.sum("mass").alias("n")).withColumn("target", conformal_rank(F.col("n"), alpha)).drop("n")
        slack = 0.0
    else:
        sizes = rows.groupBy(*by, "scene").agg(F.count("*").alias("m"), F.first("mult").alias("mult"))
        mass = rows.drop("mult").join(sizes, [*by, "scene"]).groupBy(*by, "score").agg(F.round(F.sum(F.col("mult") / F.col("m")), 12).alias("mass"))
        total = sizes.groupBy(*by).agg(((1 - alpha) * (F.sum("mult") + 1)).alias("target"))
        slack = SLACK
    seen = running(mass, by, seen="mass")
    joined = seen.join(total, by) if by else seen.crossJoin(F.broadcast(total))
    out = joined.groupBy(*by).agg(F.min(F.when(F.col("seen") >= F.col("target") - slack, F.col("score"))).alias("q"))
    return out.select(*by, F.coalesce("q", F.lit(INF)).alias("q"))


def linear_quantile(scores: DataFrame, level: float, by: list[str] = ()) -> DataFrame:
    """The interpolated quantile without any correction."""
    return scores.groupBy(*by).agg(F.percentile("score", F.lit(float(level))).alias("q"), F.count("*").alias("n"))


def coordinate_thresholds(residuals: DataFrame, alpha: float, coords: list[str], by: list[str] = ()) -> DataFrame:
    """by, coord, q, n: each of k coordinates at alpha / k (Bonferroni)."""
    long = residuals.unpivot([*by, "scene"], coords, "coord", "score")
    return pooled(long, alpha / len(coords), [*by, "coord"])


def scaled_coordinate_thresholds(residuals: DataFrame, alpha: float, coords: list[str], sigma: str, by: list[str] = ()) -> DataFrame:
    """As coordinate_thresholds, of residuals divided by the row's own scale."""
    own = residuals.select(*by, "scene", *[(F.col(c) / F.col(sigma)).alias(c) for c in coords])
    return coordinate_thresholds(own, alpha, coords, by)


def refused(support: DataFrame, alpha: float, n: str = "n") -> DataFrame:
    """``support`` with refused: the group is too small for any finite threshold at alpha."""
    return support.withColumn("refused", 1 / (F.col(n) + 1) > alpha)


def threshold_grid(scores: DataFrame, alphas: list[float], by: list[str] = (), mode: str = "scp", coords: int = 1) -> DataFrame:
    """by, alpha, q for each level: 'scp' ranks, 'bonferroni' ranks at alpha / coords, 'linear' quantiles, 'hcp' masses."""
    if mode == "linear":
        arr = scores.groupBy(*by).agg(F.percentile("score", F.array(*[F.lit(1 - a) for a in alphas])).alias("q"))
        return arr.select(*by, F.posexplode("q").alias("i", "q")).select(*by, F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("i") + 1).alias("alpha"), "q")
    levels = [check_alpha(a) for a in alphas]
    if mode == "hcp":
        wide = _hcp_levels(scores, levels, list(by))
    else:
        wide = _by_ranks(scores, list(by), [conformal_rank(F.col("n"), a / coords if mode == "bonferroni" else a) for a in levels])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"q{i}").alias("q")) for i, a in enumerate(levels)]))
    return wide.select(*by, cells.alias("x")).select(*by, "x.alpha", "x.q")


def max_rank(design: DataFrame, residuals: DataFrame, coords: list[str], key: list[str], by: list[str] = (), mult: str | None = None) -> DataFrame:
    """key, score: the largest over coordinates of the share of design residuals strictly below; ``mult`` weighs design rows.

    Design and scored values are counted together by value, so that one running sum per coordinate ranks all.
    """
    by = list(by)
    weight = F.col(mult) if mult else F.lit(1)
    d = design.withColumn("_w", weight.cast("long")).where("_w > 0").unpivot([*by, "_w"], coords, "coord", "value")
    r = residuals.unpivot([*by, *key], coords, "coord", "value")
    values = d.select(*by, "coord", "value", "_w").unionByName(r.select(*by, "coord", "value", F.lit(0).cast("long").alias("_w")))
    counts = values.groupBy(*by, "coord", "value").agg(F.sum("_w").alias("c"), F.count("*").alias("_rows"))
    below = running(counts, [*by, "coord"], "value", seen="c").select(*by, "coord", "value", (F.col("seen") - F.col("c")).alias("below"), "_rows")
    below = stored(below, "below")
    total = d.groupBy(*by, "coord").agg(F.sum("_w").alias("n"))
    # values of many rows are few and broadcast; no task gets all rows of such a value
    often = r.join(F.broadcast(below.where(F.col("_rows") > OFTEN).drop("_rows")), [*by, "coord", "value"], "left")
    rest = often.where("below is null").drop("below").join(below.where(F.col("_rows") <= OFTEN).drop("_rows"), [*by, "coord", "value"])
    ranked = often.where("below is not null").unionByName(rest).join(F.broadcast(total), [*by, "coord"])
    return ranked.groupBy(*by, *key).agg(F.max(F.col("below") / F.col("n")).alias("score"))


def max_rank_bounds(design: DataFrame, thresholds: DataFrame, coords: list[str], by: list[str] = (), mult: str | None = None, many: bool = False) -> DataFrame:
    """by, coord, q: what a max-rank threshold q (a share of design residuals strictly below) allows of each coordinate.

    The largest residual whose share strictly below is q or less: the first of a weight above q times the total; +inf
    where q is 1 or more. With ``many`` a group has several thresholds, and ``rank`` tells which a row is of.
    """
    by = list(by)
    weight = F.col(mult) if mult else F.lit(1)
    d = design.withColumn("_w", weight.cast("long")).where("_w > 0").unpivot([*by, "_w"], coords, "coord", "value")
    counts = d.groupBy(*by, "coord", "value").agg(F.sum("_w").alias("c"))
    seen = running(counts, [*by, "coord"], "value", seen="c")
    total = counts.groupBy(*by, "coord").agg(F.sum("c").alias("n"))
    wanted = total.join(thresholds.select(*by, "q"), by) if by else total.crossJoin(F.broadcast(thresholds.select("q")))
    rows = seen.join(wanted, [*by, "coord"])
    # shares are quotients of whole numbers: weights are compared after rounding the product back
    above = F.col("seen") > F.round(F.col("q") * F.col("n"), 6)
    per = [*by, F.col("q").alias("rank")] if many else by
    return rows.groupBy(*per, "coord").agg(F.coalesce(F.min(F.when(above & (F.col("q") < 1), F.col("value"))), F.lit(INF)).alias("q"))


def choose_alpha(curves: DataFrame, by: str = "class", level: str = "alpha", value: str = "coverage", target: float = 0.9) -> DataFrame:
    """One row: the level whose mean over classes is nearest ``target`` (the smallest of equally near ones), and that mean.

    Both are null where any class lacks a level or has a coverage that is not finite.
    """
    v = F.col(value)
    odd = F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == INF))
    grid = curves.groupBy(level).agg(F.avg(v).alias("macro"), F.count("*").alias("n"), odd.alias("odd"))
    most = grid.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.sum("odd").alias("odd"))
    best = grid.agg(F.min(F.struct(F.abs(F.col("macro") - target).alias("gap"), F.col(level).alias("at"), "macro")).alias("best"))
    rows = best.crossJoin(F.broadcast(most))
    ok = (F.col("most") == F.col("least")) & (F.col("odd") == 0)
    return rows.select(F.when(ok, F.col("best.at")).alias(level), F.when(ok, F.col("best.macro")).alias("macro"))
