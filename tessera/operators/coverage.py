"""Coverage, risk matrices and readouts: grouped aggregates in one or two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covered(scores: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """``scores`` with q and covered; null where the key has no threshold (out of support)."""
    return scores.join(F.broadcast(thresholds.select(*by, "q")), by, "left").withColumn("covered", F.when(F.col("q").isNotNull(), F.col("score") <= F.col("q")))


def _scene_means(rows: DataFrame, by: list[str]) -> DataFrame:
    hit = F.col("covered").cast("double")
    scenes = rows.groupBy(*by, "scene").agg(F.avg(hit).alias("share"), F.min(hit).alias("all"), F.sum(hit).alias("hits"), F.count("*").alias("m"))
    return scenes.groupBy(*by).agg(
        F.avg("share").alias("cov_scene"), (F.sum("hits") / F.sum("m")).alias("cov_object"), F.avg("all").alias("cov_sim"), F.count("*").alias("n_scenes"), F.sum("m").alias("n_objects")
    )


def evaluate(scores: DataFrame, thresholds: DataFrame, by: str = "class") -> DataFrame:
    """Scene-weighted, object-weighted and simultaneous coverage by class and overall (class null).

    Objects without a threshold are left out and counted in n_out_of_support of the overall row. The overall
    scene mean groups the scenes anew across classes.
    """
    rows = covered(scores, thresholds, [by])
    known = rows.where("covered is not null")
    classes = _scene_means(known, [by]).withColumn("n_out_of_support", F.lit(0).cast("long"))
    out = rows.agg(F.count_if(F.expr("covered is null")).alias("n_out_of_support"))
    overall = _scene_means(known, []).crossJoin(F.broadcast(out)).withColumn(by, F.lit(None).cast(scores.schema[by].dataType))
    return classes.unionByName(overall)


def simultaneous_boxes(residuals: DataFrame, thresholds: DataFrame, coords: list[str], by: list[str] = (), sigma: Column | None = None) -> DataFrame:
    """``residuals`` with covered: every coordinate within its threshold (times sigma). ``thresholds``: by, coord, q."""
    wide = thresholds.groupBy(*by).pivot("coord", coords).agg(F.first("q"))
    wide = wide.select(*by, *[F.col(f"`{c}`").alias(f"q_{c}") for c in coords])
    rows = residuals.join(wide, list(by)) if by else residuals.crossJoin(F.broadcast(wide))
    scale = sigma if sigma is not None else F.lit(1.0)
    ok = F.lit(True)
    for c in coords:
        ok = ok & (F.col(c) <= F.col(f"q_{c}") * scale)
    return rows.withColumn("covered", ok)


def miss_matrix(gt: DataFrame, grid: list[float], by: list[str] = ()) -> DataFrame:
    """by, scene, lambda, risk: share of a scene's objects without a detection of confidence lambda or more.

    One pass: conditional sums per grid value, unfolded after aggregation, so objects are not multiplied.
    """
    hits = [F.sum(F.when(F.col("conf") >= v, 0).otherwise(1)).alias(f"m{i}") for i, v in enumerate(grid)]
    wide = gt.groupBy(*by, "scene").agg(F.count("*").alias("n"), *hits)
    cells = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("lambda"), (F.col(f"m{i}") / F.col("n")).alias("risk")) for i, v in enumerate(grid)]))
    return wide.select(*by, "scene", cells.alias("c")).select(*by, "scene", "c.lambda", "c.risk")


def loss_matrix(gt: DataFrame, q_grid: list[float], lam: float, by: list[str] = ()) -> DataFrame:
    """by, scene, q, loss: 1 - share of objects detected at lambda or more with score <= q. Misses never count, not even at q = inf."""
    seen = F.col("conf") >= lam
    hits = [F.sum(F.when(seen & (F.col("score") <= float(v)), 1).otherwise(0)).alias(f"m{i}") for i, v in enumerate(q_grid)]
    wide = gt.groupBy(*by, "scene").agg(F.count("*").alias("n"), *hits)
    cells = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("q"), (1 - F.col(f"m{i}") / F.col("n")).alias("loss")) for i, v in enumerate(q_grid)]))
    return wide.select(*by, "scene", cells.alias("c")).select(*by, "scene", "c.q", "c.loss")


def operating_readout(matched: DataFrame, grid: list[float]) -> DataFrame:
    """Per lambda: tp, fp, fn, gt, fp share and recall, pooled and as scene means. ``matched``: scene, match_type, pred_score."""
    keep = lambda t, v: F.sum(F.when((F.col("match_type") == t) & (F.col("pred_score") >= v), 1).otherwise(0))
    aggs = [a for i, v in enumerate(grid) for a in (keep("tp", v).alias(f"tp{i}"), keep("fp", v).alias(f"fp{i}"))]
    scenes = matched.groupBy("scene").agg(F.count_if(F.expr("match_type in ('tp', 'fn')")).alias("gt"), *aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("lambda"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, v in enumerate(grid)]))
    long = scenes.select("scene", "gt", cells.alias("c")).select("scene", "gt", "c.lambda", "c.tp", "c.fp")
    det = F.col("tp") + F.col("fp")
    return long.groupBy("lambda").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum(F.col("gt") - F.col("tp")).alias("fn"), F.sum("gt").alias("gt"),
        F.try_divide(F.sum("fp"), F.sum(det)).alias("fp_share"), F.avg(F.when(det > 0, F.col("fp") / det)).alias("fp_share_scene"),
        F.try_divide(F.sum("tp"), F.sum("gt")).alias("recall"), F.avg(F.when(F.col("gt") > 0, F.col("tp") / F.col("gt"))).alias("recall_scene"),
    )


def strict_macro(values: DataFrame, roster: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the mean over the whole roster, null if any class is missing or undefined."""
    rows = roster.select(key).join(values.select(key, value), key, "left")
    return rows.agg(F.count("*").alias("n_classes"), F.count(value).alias("n_defined"), F.when(F.count(value) == F.count("*"), F.avg(value)).alias("macro"))


def supported_macro(values: DataFrame, roster: DataFrame, key: str, value: str) -> DataFrame:
    """The mean over classes that are defined, with the missing ones named."""
    rows = roster.select(key).join(values.select(key, value), key, "left")
    return rows.agg(F.avg(value).alias("macro"), F.count(value).alias("n_defined"), F.array_sort(F.collect_list(F.when(F.col(value).isNull(), F.col(key)))).alias("missing"))


def source_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Scene-uniform means, each object weighing mult / scene size. ``pairs``: by, scene, mult, score, q, and the metric inputs."""
    sizes = pairs.groupBy(*by, "scene").agg(F.count("*").alias("m"))
    w = F.col("mult") / F.col("m")
    rows = pairs.join(sizes, [*by, "scene"])
    mean = lambda x: F.try_divide(F.sum(w * x.cast("double")), F.sum(w))
    return rows.groupBy(*by).agg(
        mean(F.col("score") <= F.col("q")).alias("coverage"), mean(F.col("q") == float("inf")).alias("infinite"),
        mean(F.col("half_width")).alias("half_width"), mean(F.col("half_width") < 1.5707963).alias("informative"),
        mean((F.col("score") <= F.col("q")) & (F.col("half_width") < 1.5707963)).alias("joint"), F.sum(w).alias("weight"),
    )


def match_counts(matched: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, recall and precision by keys."""
    n = lambda t: F.count_if(F.col("match_type") == t)
    out = matched.groupBy(*by).agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))
    return out.select(*by, "tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"))


def staging_counts(rows: DataFrame) -> DataFrame:
    """class, scenes, crops, instances."""
    return rows.groupBy("class").agg(F.countDistinct("scene_id").alias("scenes"), F.countDistinct("image_id").alias("crops"), F.count("*").alias("instances"))


def conservation(matched: DataFrame, det: DataFrame, gt: DataFrame, by: str = "class") -> DataFrame:
    """Violations of tp + fp = detections and tp + fn = ground truth; empty if matching is sound."""
    counts = match_counts(matched, [by]).select(by, "tp", "fp", "fn")
    n = det.groupBy(by).agg(F.count("*").alias("n_det")).join(gt.groupBy(by).agg(F.count("*").alias("n_gt")), by, "full")
    rows = n.join(counts, by, "full").fillna(0, ["n_det", "n_gt", "tp", "fp", "fn"])
    return rows.where("tp + fp <> n_det or tp + fn <> n_gt")


def repeated_summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, sd, min, max over repeats."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def describe(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, sd, Monte-Carlo error, outer and middle quantiles, range, count and missing."""
    v = F.col(value)
    q = lambda p: F.percentile(v, F.lit(p))
    return values.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("mcse"), q(0.025).alias("q025"), q(0.5).alias("q500"), q(0.975).alias("q975"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"),
    )


def coverage_curve(scores: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """by, alpha, coverage over a grid of thresholds (by, alpha, q; q falls as alpha grows), without multiplying objects by it.

    Each object finds the last level that still covers it; counts per level are summed from the far end.
    """
    from pyspark.sql import Window

    levels = grid.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("alpha", "q"))).alias("levels"))
    hit = F.size(F.filter("levels", lambda x: x["q"] >= F.col("score")))
    last = scores.join(levels, by).select(*by, hit.alias("last")).groupBy(*by, "last").agg(F.count("*").alias("c"))
    total = last.groupBy(*by).agg(F.sum("c").alias("n"))
    steps = levels.select(*by, F.posexplode("levels").alias("i", "x")).select(*by, (F.col("i") + 1).alias("last"), F.col("x.alpha").alias("alpha"))
    every = steps.join(last, [*by, "last"], "left").fillna(0, ["c"])
    back = Window.partitionBy(*by).orderBy(F.col("last").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumn("hits", F.sum("c").over(back)).join(total, by).select(*by, "alpha", (F.col("hits") / F.col("n")).alias("coverage"))
