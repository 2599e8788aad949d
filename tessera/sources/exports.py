"""Checks of exported arrays and prepared tables, the box-angle convention gate, and images picked for parity checks.

Each check is a row (problem, n) of one aggregate pass; no rows mean that all hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators.ranks import numbered, running


def _told(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(problem, n) of the checks that some rows fail; a check that is null fails."""
    one = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    return one.unpivot([], list(checks), "problem", "n").where("n > 0")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def export_problems(tiles: DataFrame, gt: DataFrame, pred: DataFrame, classes: int, least_score: float = 0.05) -> DataFrame:
    """problem, n of an export of ``tiles`` (tile, name, tile_index), ``gt`` (tile, label, box) and ``pred`` (tile, box, prob).

    Boxes are arrays cx, cy, w, h, angle, the first four in [0, 1] with positive sides; prob has a value a class.
    """
    ok = lambda cond: F.forall("box", lambda v: _finite(v)) & cond
    box = {
        "box shape": F.size("box") == 5, "box not finite": F.forall("box", lambda v: _finite(v)), "side not positive": ok((F.get("box", F.lit(2)) > 0) & (F.get("box", F.lit(3)) > 0)),
        "box outside": ok(F.forall(F.slice("box", 1, 4), lambda v: (v >= 0) & (v <= 1))),
    }
    prob = F.col("prob")
    own = {
        "probabilities": F.size(prob) == classes, "probability outside": F.forall(prob, lambda v: _finite(v) & (v >= 0) & (v <= 1)), "score below floor": F.array_max(prob) >= least_score,
    }
    names = lambda kind, checks: {f"{kind}: {k}": v for k, v in checks.items()}
    out = _told(tiles, {"tiles: name missing": F.col("name").isNotNull(), "tiles: index negative": F.col("tile_index") >= 0})
    for column in ("tile", "name", "tile_index"):
        twice = tiles.groupBy(column).count().where("count > 1").agg(F.count("*").alias("n"))
        out = out.unionByName(twice.select(F.lit(f"tiles: {column} repeated").alias("problem"), "n").where("n > 0"))
    out = out.unionByName(_told(gt, names("gt", box | {"label outside": (F.col("label") >= 0) & (F.col("label") < classes)}))).unionByName(_told(pred, names("pred", box | own)))
    for kind, rows in (("gt", gt), ("pred", pred)):
        lost = rows.join(tiles.select("tile"), "tile", "left_anti").agg(F.count("*").alias("n"))
        out = out.unionByName(lost.select(F.lit(f"{kind}: unknown tile").alias("problem"), "n").where("n > 0"))
    return out


def prepared_problems(counts: DataFrame, tp: DataFrame, det: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """problem, n of prepared tables: ``counts`` (scene, class, n_gt, n_det, n_tp), ``tp`` (scene, class, pred, gt, score, iou), ``det`` (scene, class, obb)."""
    c = lambda k: F.col(k)

    def sound(box: str) -> Column:
        out = F.col(f"{box}.w") > 0
        for k in ("cx", "cy", "w", "h", "theta"):
            out = out & _finite(F.col(f"{box}.{k}"))
        return out & (F.col(f"{box}.h") > 0)

    out = _told(counts, {"count negative": (c("n_gt") >= 0) & (c("n_det") >= 0) & (c("n_tp") >= 0), "more matches than objects": c("n_tp") <= c("n_gt"), "more matches than detections": c("n_tp") <= c("n_det")})
    out = out.unionByName(_told(tp, {"pair geometry": sound("pred") & sound("gt"), "score outside": _finite(c("score")) & (c("score") >= 0), "iou outside": _finite(c("iou")) & (c("iou") >= least_iou) & (c("iou") <= 1)}))
    out = out.unionByName(_told(det, {"detection geometry": sound("obb")}))
    for kind, rows, column in (("pairs", tp, "n_tp"), ("detections", det, "n_det")):
        seen = rows.groupBy("scene", "class").agg(F.count("*").alias("seen"))
        odd = counts.select("scene", "class", column).join(seen, ["scene", "class"], "full").where(F.coalesce(F.col(column), F.lit(0)) != F.coalesce("seen", F.lit(0)))
        out = out.unionByName(odd.agg(F.count("*").alias("n")).select(F.lit(f"{kind} against counts").alias("problem"), "n").where("n > 0"))
    return out


def convention_gate(boxes: DataFrame, floor: float = 0.9) -> DataFrame:
    """One row: the median overlap of the boxes' hulls with the upright boxes that their files state, its count, and whether it passes.

    ``boxes``: obb and x0, y0, x1, y1. A wrong angle convention shows as a low median. Without any stated box it is 0.
    """
    h = B.hull(F.col("obb"))
    x0, x1, y0, y1 = h["cx"] - h["half_w"], h["cx"] + h["half_w"], h["cy"] - h["half_h"], h["cy"] + h["half_h"]
    w = F.greatest(F.lit(0.0), F.least(x1, F.col("x1")) - F.greatest(x0, F.col("x0")))
    t = F.greatest(F.lit(0.0), F.least(y1, F.col("y1")) - F.greatest(y0, F.col("y0")))
    both = (x1 - x0) * (y1 - y0) + (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) - w * t
    rows = boxes.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").select(F.coalesce(F.try_divide(w * t, both), F.lit(0.0)).alias("iou"))
    seen = running(rows.groupBy("iou").agg(F.count("*").alias("c")), [], "iou", seen="c").select("iou", "seen")
    n = rows.agg(F.count("*").alias("n"))
    at = lambda rank: F.min(F.when(F.col("seen") >= rank, F.col("iou")))
    middle = seen.crossJoin(F.broadcast(n)).agg(at(F.floor((F.col("n") + 1) / 2)).alias("low"), at(F.floor(F.col("n") / 2) + 1).alias("high"))
    out = n.crossJoin(F.broadcast(middle)).select(F.coalesce(0.5 * F.col("low") + 0.5 * F.col("high"), F.lit(0.0)).alias("median_iou"), "n")
    return out.withColumn("passes", F.col("median_iou") >= floor)


def parity_picks(images: DataFrame, spread: int = 12, dense: int = 3, wanted: int = 12) -> DataFrame:
    """image_id of the images picked for parity checks: ``spread`` at even steps by name, and the ``dense`` nearest to ``wanted`` objects.

    ``images``: image_id, n_det, n_gt; only those with both take part. The picks are the feature: 15 images at most.
    """
    both = images.where("n_det > 0 and n_gt > 0").select("image_id", "n_gt")
    total = both.agg(F.count("*").alias("n"))
    placed = numbered(both, [], ["image_id"], "i").crossJoin(F.broadcast(total))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / spread))
    even = placed.where(((F.col("i") - 1) % step == 0) & ((F.col("i") - 1) / step < spread)).select("image_id")
    near = both.orderBy(F.abs(F.col("n_gt") - wanted), "image_id").limit(dense).select("image_id")
    return even.unionByName(near).distinct()
