"""Study-level readouts: composition under shift, window assignment, certificates by route, interval diagnostics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box, overlap_area
from ..sources.scratch import stored
from .ranks import numbered, running
from .risk import binomial_cdf, tolerance_rank

#: Radii tried by the fixed sequences, from the largest down.
Q_GRID = [float(2 ** (i / 2)) for i in range(0, 15)]


def area_summary(rows: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """mean, median and counts of areas; null is out of support, infinite areas count as such and enter both."""
    c, inf = F.col(column), float("inf")
    return rows.groupBy(*by).agg(
        F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.count("*").alias("n_sample"), F.count(c).alias("n_supported"),
        F.count_if(c < inf).alias("n_finite"), F.count_if(c == inf).alias("n_infinite"), F.count_if(c.isNull()).alias("n_out_of_support"),
    )


def window_assignment(boxes: DataFrame, windows: DataFrame, size: int = 1024, least: float = 0.7) -> DataFrame:
    """picture, idx, class, x0, y0, iof, difficult, obb: boxes of which ``least`` lies in a window, in its coordinates.

    Cut boxes become difficult (2). Only windows whose square the box's centre circle can reach are tried.
    """
    near = boxes.join(windows.select("picture", "x0", "y0"), "picture")
    b = F.col("obb")
    r = F.sqrt(b["w"] * b["w"] + b["h"] * b["h"]) / 2
    near = near.where((b["cx"] + r > F.col("x0")) & (b["cx"] - r < F.col("x0") + size) & (b["cy"] + r > F.col("y0")) & (b["cy"] - r < F.col("y0") + size))
    window = box(F.col("x0") + size / 2, F.col("y0") + size / 2, F.lit(float(size)), F.lit(float(size)), F.lit(0.0))
    iof = F.least(F.lit(1.0), overlap_area(window, b) / F.greatest(b["w"] * b["h"], F.lit(1e-6)))
    kept = near.withColumn("iof", iof).where(F.col("iof") >= least)
    moved = box(b["cx"] - F.col("x0"), b["cy"] - F.col("y0"), b["w"], b["h"], b["theta"])
    return kept.select("picture", "idx", "class", "x0", "y0", "iof", F.when(F.col("iof") < 1 - 1e-9, 2).otherwise(F.col("difficult")).alias("difficult"), moved.alias("obb"))


def tile_accounting(boxes: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: boxes, boxes in some window, boxes in none, copies emitted."""
    hit = assigned.groupBy("picture", "idx").agg(F.count("*").alias("n"))
    rows = boxes.select("picture", "idx").join(hit, ["picture", "idx"], "left")
    return rows.agg(F.count("*").alias("boxes"), F.count("n").alias("represented"), F.count_if(F.col("n").isNull()).alias("unrepresented"), F.coalesce(F.sum("n"), F.lit(0)).alias("emitted"))


def composition(clean: DataFrame, shifted: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row: coverage and median score of objects matched in both conditions and of those lost under the shift.

    Tables hold scene, class, gt and score; objects are the same where the box agrees to four decimals.
    """
    key = lambda d, s: d.select("scene", "class", *[F.round(F.col("gt")[k], 4).alias(k) for k in ("cx", "cy", "w", "h", "theta")], F.col("score").alias(s))
    on = ["scene", "class", "cx", "cy", "w", "h", "theta"]
    rows = key(clean, "before").join(key(shifted, "after"), on, "left").join(F.broadcast(thresholds.select("class", "q")), "class")
    both, lost = F.col("after").isNotNull(), F.col("after").isNull()
    hit = lambda s: (F.col(s) <= F.col("q")).cast("double")
    return rows.agg(
        F.count_if(both).alias("shared"), F.count_if(lost).alias("lost"), F.avg(F.when(both, hit("before"))).alias("cov_shared_before"), F.avg(F.when(both, hit("after"))).alias("cov_shared_after"),
        F.avg(F.when(lost, hit("before"))).alias("cov_lost_before"), F.percentile(F.when(both, F.col("before")), F.lit(0.5)).alias("median_before"), F.percentile("after", F.lit(0.5)).alias("median_after"),
    )


def representatives(scores: DataFrame, by: list[str], seed: int, miss: float = 0.1, delta: float = 0.05) -> DataFrame:
    """by, q, n, rank: an order statistic of one object drawn per scene, at the rank that tolerates ``miss`` with confidence 1 - delta.

    ``scores``: by, scene, mult, score. Every copy of a scene draws for itself, by its own seeded stream.
    """

    def draw(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                rng = np.random.default_rng(np.random.SeedSequence([seed, *str(row.scene).encode()]))
                out += [(*(getattr(row, k) for k in keys), row.scores[i]) for i in rng.integers(0, len(row.scores), int(row.mult))]
            yield pd.DataFrame(out, columns=[*by, "score"])

    keys = [f"key{i}" for i in range(len(by))]
    sets = scores.where("mult > 0").groupBy(*by, "scene").agg(F.array_sort(F.collect_list("score")).alias("scores"), F.first("mult").alias("mult"))
    kinds = ", ".join(f"`{k}` {scores.schema[k].dataType.simpleString()}" for k in by)
    drawn = stored(sets.select(*[F.col(k).alias(n) for k, n in zip(by, keys)], "scene", "scores", "mult").mapInPandas(draw, f"{kinds}, score double"), "representatives")
    counts = drawn.groupBy(*by).agg(F.count("*").alias("n"))
    ranks = {r.n: tolerance_rank(r.n, 1 - miss, delta) for r in counts.select("n").distinct().collect()}
    table = scores.sparkSession.createDataFrame([(n, k) for n, k in ranks.items()] or [(0, None)], "n long, rank long")
    seen = running(drawn.groupBy(*by, "score").agg(F.count("*").alias("c")), list(by), seen="c")
    wanted = counts.join(F.broadcast(table), "n")
    return wanted.join(seen, by).groupBy(*by).agg(F.min(F.when(F.col("seen") >= F.col("rank"), F.col("score"))).alias("q"), F.first("n").alias("n"), F.first("rank").alias("rank"))


def routes(hcp: DataFrame, representative: DataFrame, bernstein: DataFrame, direct: DataFrame, recall: DataFrame, by: str = "class") -> DataFrame:
    """by, route, q, status (0 none, 1 finite, 2 whole space) of the localisation routes, alone and joined with recall.

    ``direct`` and ``recall`` hold by, beta and q or passes; a joint route stands only where recall passes at its beta.
    """
    one = lambda d, name: d.select(by, F.lit(name).alias("route"), "q")
    out = one(hcp, "hcp").unionByName(one(representative, "representative")).unionByName(one(bernstein, "bernstein"))
    out = out.unionByName(direct.select(by, F.concat(F.lit("direct@"), F.col("beta").cast("string")).alias("route"), "q"))
    for name, d in (("representative", representative), ("bernstein", bernstein)):
        j = d.join(recall, by).select(by, F.concat(F.lit(f"{name}+recall@"), F.col("beta").cast("string")).alias("route"), F.when(F.col("passes"), F.col("q")).alias("q"))
        out = out.unionByName(j)
    return out.withColumn("status", F.when(F.col("q").isNull(), 0).when(F.col("q") == float("inf"), 2).otherwise(1))


def order_ranks(n: int, p: float) -> tuple[int, int]:
    """Ranks of the sorted draws that bracket their p-quantile with binomial confidence 0.95."""

    def quantile(level: float) -> int:
        lo, hi = -1, n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if binomial_cdf(mid, n, p) >= level else (mid, hi)
        return hi

    return quantile(0.025), quantile(0.975) + 1


def interval_report(draws: DataFrame, by: list[str], level: float = 0.95, value: str = "value", blocks: int = 5) -> DataFrame:
    """by, low, high, tail brackets, block agreement and a sign status of percentile intervals.

    Withheld if a draw is undefined; infinite draws stay. The sign is unresolved where a bracket touches zero and is
    claimed only if all blocks of draws agree.
    """
    tail = (1 - level) / 2
    n = F.count("*")
    draws = stored(draws.select(*by, "draw", value), "values")
    sizes = [r[0] for r in draws.groupBy(*by).agg(n.alias("n")).select("n").distinct().collect()]
    table = draws.sparkSession.createDataFrame([(s, *order_ranks(s, tail), *order_ranks(s, 1 - tail)) for s in sizes] or [(0, 0, 0, 0, 0)], "n long, l1 long, u1 long, l2 long, u2 long")
    bad = F.count_if(F.col(value).isNull() | F.isnan(value))
    both = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    whole = draws.groupBy(*by).agg(both.alias("q"), n.alias("n"), bad.alias("missing"), F.array_sort(F.collect_list(value)).alias("sorted")).join(F.broadcast(table), "n")
    at = lambda r: F.when(F.col(r) <= 0, F.lit(-math.inf)).when(F.col(r) > F.col("n"), F.lit(math.inf)).otherwise(F.get("sorted", (F.col(r) - 1).cast("int")))
    sign = lambda a, b: F.when(a > 0, "positive").when(b < 0, "negative").otherwise("touches_zero")
    total = draws.groupBy(*by).agg((F.max("draw") + 1).alias("total"))
    signs = draws.join(total, by).groupBy(*by, F.floor(F.col("draw") * blocks / F.col("total")).alias("block")).agg(both.alias("b")).groupBy(*by).agg(F.array_sort(F.collect_set(sign(F.col("b")[0], F.col("b")[1]))).alias("block_signs"))
    rows = whole.join(signs, by)
    ok = F.col("missing") == 0
    low, high = F.col("q")[0], F.col("q")[1]
    touches = ((at("l1") <= 0) & (at("u1") >= 0)) | ((at("l2") <= 0) & (at("u2") >= 0))
    status = F.when(~ok, "unavailable").when(touches, "numerically_unresolved").otherwise(F.when(sign(low, high) == "touches_zero", "interval_includes_zero").otherwise(sign(low, high)))
    claim = ok & ~touches & (sign(low, high) != "touches_zero") & (F.size("block_signs") == 1) & (F.col("block_signs")[0] == sign(low, high))
    return rows.select(*by, F.when(ok, low).alias("low"), F.when(ok, high).alias("high"), at("l1").alias("low_from"), at("u1").alias("low_to"), at("l2").alias("high_from"), at("u2").alias("high_to"), status.alias("status"), claim.alias("sign_claimed"))


def bias_corrected_interval(values: np.ndarray, resamples: int = 9999, level: float = 0.95, seed: int = 0) -> tuple[float, float]:
    """Accelerated bootstrap interval of a mean, for the few values of repeated splits."""
    from statistics import NormalDist

    x, rng, z = np.asarray(values, float), np.random.default_rng(seed), NormalDist()
    means = x[rng.integers(0, len(x), (resamples, len(x)))].mean(axis=1)
    share = (np.sum(means < x.mean()) + np.sum(means == x.mean()) / 2) / resamples
    shift = z.inv_cdf(min(1 - 1e-9, max(1e-9, share)))
    left = (x.sum() - x) / (len(x) - 1)
    d = left.mean() - left
    a = float((d**3).sum() / (6 * (d**2).sum() ** 1.5)) if (d**2).sum() > 0 else 0.0
    cut = [z.cdf(shift + (shift + q) / (1 - a * (shift + q))) for q in (z.inv_cdf((1 - level) / 2), z.inv_cdf((1 + level) / 2))]
    return tuple(float(v) for v in np.quantile(means, cut))


def set_size_contrast(sizes: DataFrame, primary: str, baseline: str, block: str, permutations: int = 2000, draws: int = 1000, seed: int = 0) -> dict:
    """Mean log ratio of two set sizes, its block bootstrap interval and one-sided sign-flip p-value.

    Blocks are aggregated in Spark first; what reaches the driver is a sum and a count per block (a class).
    """
    from .splits import sign_flip

    rows = sizes.select(block, (F.log(primary) - F.log(baseline)).alias("r"))
    b = rows.groupBy(block).agg(F.sum("r").alias("s"), F.count("*").alias("n")).orderBy(block).toPandas()
    rng = np.random.default_rng(seed)
    pick = rng.integers(0, len(b), (draws, len(b)))
    boot = b.s.to_numpy()[pick].sum(1) / b.n.to_numpy()[pick].sum(1)
    point = float(b.s.sum() / b.n.sum())
    return {"log_ratio": point, "ratio": math.exp(point), "low": float(np.quantile(boot, 0.025)), "high": float(np.quantile(boot, 0.975)), "p_value": sign_flip((b.s / b.n).to_numpy(), permutations, seed), "blocks": len(b)}


def cell_tables(matched: DataFrame) -> dict[str, DataFrame]:
    """The columnar cell of match records: tp, fn and fp with scene and class codes, and the dictionaries.

    Codes follow the sorted names; scenes carry their number of images. The records are written once, as dictionaries and parts
    each read them; boxes, scores and overlaps may be left out of them, and are then of the parts, too.
    """
    matched = stored(matched, "matched")

    def dictionary(column: str, code: str, *more):
        names = matched.groupBy(column).agg(F.countDistinct("image_id").alias("n_tiles"))
        placed = numbered(names, [], [column], "_i")
        return placed.select((F.col("_i") - 1).cast("int").alias(code), column, *more)

    scenes, classes = dictionary("scene_id", "scene_code", "n_tiles"), dictionary("class", "class_code")
    rows = matched.join(scenes.select("scene_code", "scene_id"), "scene_id").join(F.broadcast(classes), "class")
    names = {"pred_obb": "pred_obb", "gt_obb": "gt_obb", "pred_score": "conf", "iou": "iou"}
    part = lambda t, *c: rows.where(F.col("match_type") == t).select("scene_code", "class_code", *[F.col(x).alias(names[x]) for x in c if x in matched.columns])
    return {"tp": part("tp", *names), "fn": part("fn"), "fp": part("fp", "pred_score"), "scenes": scenes, "classes": classes}
