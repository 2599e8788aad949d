"""Matching of detections to ground truth within an image and class."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import hull_iou, rotated_iou
from .ranks import highest_so_far, ranged, running


def candidates(det: DataFrame, gt: DataFrame, tau: float, iou: Callable[[Column, Column], Column] = rotated_iou, keys: tuple[str, ...] = ("image_id", "class")) -> DataFrame:
    """keys, det_idx, score, gt_idx, iou of the pairs of IoU tau or more.

    An equi-join on the keys; squares round the boxes must overlap, which a positive IoU, of boxes or of envelopes, implies.
    """
    d = det.select(*keys, F.col("idx").alias("det_idx"), "score", F.col("obb").alias("d_obb"))
    g = gt.select(*keys, F.col("idx").alias("gt_idx"), F.col("obb").alias("g_obb"))
    near = _meeting(d, g, list(keys)) if tau > 0 else d.join(g, list(keys))
    return near.withColumn("iou", iou(F.col("d_obb"), F.col("g_obb"))).where(F.col("iou") >= tau).select(*keys, "det_idx", "score", "gt_idx", "iou")


def _meeting(d: DataFrame, g: DataFrame, keys: list[str]) -> DataFrame:
    """``d`` joined with ``g`` where the upright squares round the circles of d_obb and g_obb meet; they hold the envelopes, too.

    Squares follow from centres and sides, so neither angles are reckoned once a pair nor envelopes shuffled with the boxes.
    """
    d_, g_ = F.col("d_obb"), F.col("g_obb")
    across = lambda b: F.sqrt(b["w"] * b["w"] + b["h"] * b["h"])
    reach = (across(d_) + across(g_)) * (0.5 + 1e-9)
    return d.join(g, keys).where((F.abs(d_["cx"] - g_["cx"]) < reach) & (F.abs(d_["cy"] - g_["cy"]) < reach))


def _folded(taus: list[float]):
    """Greedy choice over candidates that come sorted by group, falling score, detection and falling overlap.

    Each row is looked at once: it is taken where its detection has no partner yet and its object is free, for each
    threshold by itself. A group's state is the set of taken objects; groups may run on over batches.
    """

    def fold(batches):
        group, state = None, []
        for b in batches:
            b = pa.Table.from_batches([b])
            keys = list(zip(*(b.column(f"k{i}").to_pylist() for i in range(b.num_columns - 3))))
            det, gt, iou = (b.column(c).to_pylist() for c in ("det_idx", "gt_idx", "iou"))
            at, level = [], []
            for i, key in enumerate(keys):
                if key != group:
                    group, state = key, [(set(), set()) for _ in taus]
                for tau, (dets, gts) in zip(taus, state):
                    if iou[i] < tau:
                        break  # thresholds rise
                    if det[i] not in dets and gt[i] not in gts:
                        dets.add(det[i])
                        gts.add(gt[i])
                        at.append(i)
                        level.append(tau)
            if at:
                out = b.take(pa.array(at, pa.int64())).append_column("tau", pa.array(level, pa.float64()))
                yield from out.combine_chunks().to_batches()

    return fold


def greedy_levels(cands: DataFrame, taus: list[float], keys: tuple[str, ...] = ("image_id", "class"), tie: str = "first") -> DataFrame:
    """tau, keys, det_idx, gt_idx, iou: ``greedy`` at several least overlaps in one pass over the sorted candidates."""
    place = F.col("gt_idx") if tie == "first" else -F.col("gt_idx")
    names = [f"k{i}" for i in range(len(keys))]
    rows = cands.where(F.col("iou") >= min(taus)).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "det_idx", "gt_idx", "iou", (-F.col("score")).alias("s"), place.alias("p"))
    dealt = rows.repartition(*names).sortWithinPartitions(*names, "s", "det_idx", F.col("iou").desc(), "p").drop("s", "p")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    folded = dealt.mapInArrow(_folded(sorted(float(t) for t in taus)), f"{kinds}, tau double")
    return folded.select("tau", *[F.col(n).alias(k) for n, k in zip(names, keys)], "det_idx", "gt_idx", "iou")


def greedy(cands: DataFrame, keys: tuple[str, ...] = ("image_id", "class"), tie: str = "first") -> DataFrame:
    """keys, det_idx, gt_idx, iou: detections by falling score (then idx) take their best free partner.

    Equal IoU goes to the lowest gt_idx ('first') or the highest ('last').
    """
    return greedy_levels(cands, [-1.0], keys, tie).drop("tau")


def matched(det: DataFrame, gt: DataFrame, tau: float, iou: Callable[[Column, Column], Column] = rotated_iou, tie: str = "first") -> DataFrame:
    """Match records (image_id, scene_id, class, pred_obb, gt_obb, pred_score, iou, match_type) of tp, fp and fn.

    Images with only detections or only objects give fp or fn rows. Matches are joined to the detections and the result
    to the objects, each once, so candidates are overlapped once.
    """
    keys = ["image_id", "class"]
    m = greedy(candidates(det, gt, tau, iou), tie=tie)
    d = det.select(*keys, F.col("idx").alias("det_idx"), F.col("scene_id").alias("d_scene"), F.col("obb").alias("pred_obb"), F.col("score").alias("pred_score"), F.lit(1).alias("is_det"))
    g = gt.select(*keys, F.col("idx").alias("gt_idx"), F.col("scene_id").alias("g_scene"), F.col("obb").alias("gt_obb"), F.lit(1).alias("is_gt"))
    rows = d.join(m, [*keys, "det_idx"], "left").join(g, [*keys, "gt_idx"], "full")
    kind = F.when(F.col("is_det").isNull(), "fn").when(F.col("is_gt").isNull(), "fp").otherwise("tp")
    return rows.select("image_id", F.coalesce("d_scene", "g_scene").alias("scene_id"), "class", "pred_obb", "gt_obb", "pred_score", "iou", kind.alias("match_type"))


def hull_matched(det: DataFrame, gt: DataFrame, tau: float) -> DataFrame:
    return matched(det, gt, tau, hull_iou)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost: shortest augmenting paths with dual prices."""
    cost = np.asarray(cost, float)
    turned = cost.shape[0] > cost.shape[1]
    if turned:
        cost = cost.T
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        far, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, base, last = row, 0.0, -1
        while True:
            reduced = base + cost[i] - u[i] - v
            better = ~done & (reduced < far)
            far[better], came[better] = reduced[better], last
            j = int(np.where(done, np.inf, far).argmin())
            base, last = far[j], j
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
        seen = done & (np.arange(m) != last)
        for c in np.flatnonzero(seen):
            u[owner[c]] += base - far[c]
            v[c] -= base - far[c]
        u[row] += base
        while last >= 0:
            before = came[last]
            owner[last] = row if before < 0 else owner[before]
            last = before
    out = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    return sorted((c, r) if turned else (r, c) for r, c in out)


def hungarian(det: DataFrame, gt: DataFrame, least_score: float = 0.5, least_iou: float = 0.5, iou: Callable[[Column, Column], Column] = rotated_iou) -> DataFrame:
    """image_id, det_idx, gt_idx, iou, same_class: class-agnostic assignment of least total 1 - IoU.

    Only detections above least_score take part and only pairs above least_iou, at least 0, are kept. Pairs without an
    overlap neither lower the cost nor are kept, so only overlapping pairs are looked at. Where no box of an image overlaps
    two others all its pairs are taken; else the solver sees the boxes of that image that overlap.
    """
    d = det.where(F.col("score") > least_score).select("image_id", F.col("idx").alias("det_idx"), F.col("class").alias("d_class"), F.col("obb").alias("d_obb"))
    g = gt.select("image_id", F.col("idx").alias("gt_idx"), F.col("class").alias("g_class"), F.col("obb").alias("g_obb"))
    near = _meeting(d, g, ["image_id"])
    near = near.select("image_id", "det_idx", "gt_idx", iou(F.col("d_obb"), F.col("g_obb")).alias("iou"), (F.col("d_class") == F.col("g_class")).alias("same_class")).where("iou > 0")
    dealt = near.repartition("image_id").sortWithinPartitions("image_id", "det_idx", "gt_idx")
    return dealt.mapInArrow(_assigned(max(0.0, least_iou)), "image_id string, det_idx long, gt_idx long, iou double, same_class boolean")


def _assigned(least: float):
    """Least-cost pairs above ``least`` of rows that come sorted by image; images may run on over batches."""

    def taken(det: list, gt: list, iou: list) -> list[int]:
        rows, cols = {x: i for i, x in enumerate(sorted(set(det)))}, {x: i for i, x in enumerate(sorted(set(gt)))}
        if len(rows) == len(det) and len(cols) == len(gt):
            return [i for i, v in enumerate(iou) if v > least]
        cost, place = np.ones((len(rows), len(cols))), {}
        for i, (x, y, v) in enumerate(zip(det, gt, iou)):
            cost[rows[x], cols[y]] = 1 - v
            place[rows[x], cols[y]] = i
        return [i for pair in assignment(cost) if (i := place.get(pair)) is not None and iou[i] > least]

    def chosen(t: pa.Table):
        image = t.column("image_id").combine_chunks()
        n = t.num_rows
        first = np.ones(n, bool)
        first[1:] = pc.not_equal(image.slice(1), image.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, n))
        iou = t.column("iou").to_numpy()
        at = begin[(size == 1) & (iou[begin] > least)].tolist()
        many = size > 1
        det, gt = t.column("det_idx").to_numpy(), t.column("gt_idx").to_numpy()
        for i, k in zip(begin[many].tolist(), size[many].tolist()):
            at += [i + j for j in taken(det[i : i + k].tolist(), gt[i : i + k].tolist(), iou[i : i + k].tolist())]
        return t.take(pa.array(at, pa.int64())).combine_chunks().to_batches()

    def solve(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            image = t.column("image_id")
            last = pc.index(image, image[-1]).as_py()  # rows are sorted: the last image, which may go on, begins here
            if last:
                yield from chosen(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield from chosen(held)

    return solve


def maximum_matching(edges: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """by, size: number of pairs of a largest one-to-one matching, by augmenting paths."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf[left], pdf[right]):
            near.setdefault(a, []).append(b)
        mate: dict = {}

        def augment(a, seen) -> bool:
            for b in near[a]:
                if b not in seen:
                    seen.add(b)
                    if b not in mate or augment(mate[b], seen):
                        mate[b] = a
                        return True
            return False

        return pd.DataFrame({by: [pdf[by].iloc[0]], "size": [sum(augment(a, set()) for a in sorted(near))]})

    kind = edges.schema[by].dataType.simpleString()
    return edges.select(by, left, right).distinct().groupBy(by).applyInPandas(solve, f"{by} {kind}, size long")


def match_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: pairs in both, only in a, only in b."""
    sides = a.select(*keys).distinct().withColumn("a", F.lit(1)).join(b.select(*keys).distinct().withColumn("b", F.lit(1)), keys, "full")
    return sides.agg(F.count_if(F.expr("a is not null and b is not null")).alias("shared"), F.count_if(F.expr("b is null")).alias("only_a"), F.count_if(F.expr("a is null")).alias("only_b"))


def average_precision(det: DataFrame, gt: DataFrame, taus: list[float], per_image: int = 300, per_class: int = 100, iou: Callable[[Column, Column], Column] = rotated_iou) -> DataFrame:
    """tau, class, ap: all-point interpolated precision of the best per_image detections (per_class of a class) of each image.

    One greedy pass serves all thresholds. Precision is a running sum by falling score and its envelope a running
    maximum by rising score, both over score ranges of a class.
    """
    top = lambda cols: Window.partitionBy(*cols).orderBy(F.col("score").desc(), "idx")
    kept = det.withColumn("r", F.row_number().over(top(["image_id"]))).where(F.col("r") <= per_image)
    kept = kept.withColumn("r", F.row_number().over(top(["image_id", "class"]))).where(F.col("r") <= per_class).drop("r")
    levels = [float(t) for t in taus]
    hits = greedy_levels(candidates(kept, gt, min(levels), iou), levels).groupBy("image_id", "class", F.col("det_idx").alias("idx")).agg(F.collect_set("tau").alias("hit"))
    flags = kept.select("image_id", "class", "idx", "score").join(hits, ["image_id", "class", "idx"], "left")
    counts = flags.groupBy("class", "score").agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("hit", t)).alias(f"tp{i}") for i, t in enumerate(levels)])
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"tp{i}").alias("tp")) for i, t in enumerate(levels)]))
    steps = counts.select("class", (-F.col("score")).alias("fall"), "n", cells.alias("x")).select("x.tau", "class", "fall", "n", "x.tp")
    seen = running(steps, ["tau", "class"], "fall", all_tp="tp", all_n="n").drop("_range")
    curve = ranged(seen.select("tau", "class", "tp", (-F.col("fall")).alias("rise"), (F.col("all_tp") / F.col("all_n")).alias("precision")), ["tau", "class"], "rise")
    best = highest_so_far(curve, ["tau", "class"], "rise", "precision", "best")
    total = gt.groupBy("class").agg(F.count("*").alias("n_gt"))
    ap = best.groupBy("tau", "class").agg(F.sum(F.col("tp") * F.col("best")).alias("area"))
    every = total.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in levels])))
    return every.join(ap, ["tau", "class"], "left").select("tau", "class", F.coalesce(F.col("area") / F.col("n_gt"), F.lit(0.0)).alias("ap"))
