"""Command line: ingest, match, calibrate, recall, certify, audit and report, one after another over files."""

from __future__ import annotations

import argparse
import json
import math
import pathlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrow, boxes
from .operators import coverage, matching, risk, splits, thresholds
from .sources import records

OVERLAPS = {"rotated": boxes.rotated_iou, "hull": boxes.hull_iou}


def session() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _matched(spark: SparkSession, path: str) -> DataFrame:
    return records.read_lines(spark, path, records.MATCHED)


def _pairs(rows: DataFrame, score: str) -> DataFrame:
    """Matched pairs as scene, class and residual columns of a score."""
    tp = rows.where("match_type = 'tp'")
    a, b = F.col("pred_obb"), F.col("gt_obb")
    base = [F.coalesce("scene_id", "image_id").alias("scene"), "class", F.col("pred_obb").alias("obb")]
    if score in boxes.SCALAR:
        return tp.select(*base, boxes.SCALAR[score](a, b).alias("score"))
    return tp.select(*base, *[v.alias(k) for k, v in boxes.COORDINATES[score](a, b).items()])


def _coords(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("scene", "class", "obb")]


def _plain(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None if math.isnan(value) else str(value)
    return value


def _emit(rows: list[dict], to: str | None) -> None:
    text = json.dumps([{k: _plain(v) for k, v in r.items()} for r in rows], indent=1, sort_keys=True)
    if to:
        path = pathlib.Path(to)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(path.suffix + ".part")
        part.write_text(text)
        part.rename(path)
    else:
        print(text)


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = records.read_detections(spark, a.source) if a.kind == "detections" else records.read_truth(spark, a.source)
    records.write_lines(rows, a.out)


def match(spark: SparkSession, a: argparse.Namespace) -> None:
    det = records.with_index(records.read_detections(spark, a.detections))
    gt = records.with_index(records.read_truth(spark, a.truth))
    records.write_lines(matching.matched(det, gt, a.iou, OVERLAPS[a.overlap], a.tie), a.out)


def calibrate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Thresholds per coordinate (and class); groups too small for any finite one are refused."""
    rows = _pairs(_matched(spark, a.matched), a.score)
    if not a.by_class:
        rows = rows.withColumn("class", F.lit("all"))
    coords = _coords(rows)
    if a.method == "pooled":
        long = rows.unpivot(["class", "scene"], coords, "coord", "score")
        q = thresholds.pooled(long, a.alpha / len(coords), ["class", "coord"])
    elif len(coords) == 1:
        q = thresholds.class_thresholds(rows, a.alpha, a.method, a.bound).select("class", F.lit("score").alias("coord"), F.col("q_hat").alias("q"), F.col("n_objects").alias("n"))
    else:
        raise SystemExit("scene-aware methods take one-valued scores")
    out = thresholds.refused(q, a.alpha / len(coords)).withColumn("score_name", F.lit(a.score)).withColumn("alpha", F.lit(a.alpha)).orderBy("class", "coord")
    _emit([r.asDict() for r in out.collect()], a.out)


def recall(spark: SparkSession, a: argparse.Namespace) -> None:
    """Diagnostic threshold tests of the miss rate over the fixed grid."""
    rows = records.require_scenes(_matched(spark, a.matched)).where("match_type <> 'fp'")
    gt = rows.select("class", F.col("scene_id").alias("scene"), F.col("pred_score").alias("conf"))
    by = ["class"] if a.by_class else []
    trace = risk.ltt(coverage.miss_matrix(gt, risk.FIXED_GRID, by), a.beta, a.delta, by, a.procedure, a.p_value)
    _emit([r.asDict() for r in trace.orderBy(*by, "lambda").collect()], a.out)


def certify(spark: SparkSession, a: argparse.Namespace) -> None:
    """Regions of detections under a certificate of the distance score."""
    cert = [r for r in json.loads(pathlib.Path(a.certificate).read_text()) if r["score_name"] == "gwd"]
    if not cert:
        raise SystemExit("the certificate is not of the gwd score")
    number = lambda v: float("inf") if v == "inf" else v
    q = spark.createDataFrame([(r["class"], number(r["q"])) for r in cert], "class string, q double")
    det = records.read_detections(spark, a.detections)
    if {r["class"] for r in cert} == {"all"}:
        q = det.select("class").distinct().crossJoin(F.broadcast(q.select("q")))
    records.write_lines(arrow.regions(det, q), a.out)


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    """Coverage of the pooled threshold by orientation stratum, with scene-bootstrap intervals."""
    rows = _pairs(records.require_scenes(_matched(spark, a.matched)), "gwd")
    q = thresholds.pooled(rows, a.alpha).first().q
    hits = rows.withColumn("stratum", F.explode(F.array(F.lit("all"), boxes.theta_stratum(F.col("obb")))))
    scenes = hits.groupBy("stratum", "scene").agg(F.sum((F.col("score") <= q).cast("bigint")).alias("hits"), F.count("*").alias("n"))
    drawn = splits.resampled(spark, scenes.select(F.col("scene").alias("scene_id"), F.lit("all").alias("role")).distinct(), a.draws, a.seed).withColumnRenamed("scene_id", "scene")
    ci = splits.interval(splits.blocked_ratio(scenes, drawn, "scene", "hits", "n", ["stratum"]), ["stratum"]).drop("n")
    point = scenes.groupBy("stratum").agg((F.sum("hits") / F.sum("n")).alias("coverage"), F.sum("n").alias("n"), F.count("*").alias("scenes"))
    _emit([r.asDict() for r in point.join(ci, "stratum").orderBy("stratum").collect()], a.out)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    """A Markdown table of a JSON result."""
    rows = json.loads(pathlib.Path(a.result).read_text())
    keys = sorted({k for r in rows for k in r})
    lines = ["| " + " | ".join(keys) + " |", "|" + " - |" * len(keys)] + ["| " + " | ".join(str(r.get(k, "")) for k in keys) + " |" for r in rows]
    text = "\n".join(lines) + "\n"
    if a.out:
        pathlib.Path(a.out).write_text(text)
    else:
        print(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    verbs = p.add_subparsers(required=True)

    def verb(f, *names, **options):
        v = verbs.add_parser(f.__name__)
        for n in names:
            v.add_argument(f"--{n.replace('_', '-')}", required=True)
        for n, d in options.items():
            kind = {"action": "store_true"} if d is False else {"choices": d, "default": d[0]} if isinstance(d, list) else {"type": type(d) if d is not None else str, "default": d}
            v.add_argument(f"--{n.replace('_', '-')}", **kind)
        v.set_defaults(run=f)

    verb(ingest, "source", "out", kind=["detections", "truth"])
    verb(match, "detections", "truth", "out", iou=0.5, overlap=list(OVERLAPS), tie=["first", "last"])
    verb(calibrate, "matched", score=["gwd", *sorted({*boxes.SCALAR, *boxes.COORDINATES} - {"gwd"})], alpha=0.1, method=list(thresholds.METHODS), bound=100, by_class=False, out=None)
    verb(recall, "matched", beta=0.1, delta=0.05, procedure=["bonferroni", "fixed-sequence"], p_value=["eb", "hb"], by_class=False, out=None)
    verb(certify, "detections", "certificate", "out")
    verb(audit, "matched", alpha=0.1, draws=1000, seed=0, out=None)
    verb(report, "result", out=None)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(session(), a)
    except (records.SchemaError, thresholds.CalibrationError, risk.GridProvenanceError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
