"""Detection and ground-truth records as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import BOX
from ..functions.names import filled_scene

DETECTION = "image_id string, scene_id string, class string, obb array<double>, score double"
TRUTH = "image_id string, scene_id string, class string, obb array<double>, gt_id string"
MATCHED = f"image_id string, scene_id string, class string, pred_obb {BOX}, gt_obb {BOX}, pred_score double, iou double, match_type string"


class SchemaError(ValueError):
    """Records that do not follow their schema."""


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file by a declared schema; blank lines are skipped, bad lines and empty files raise."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kept = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "true"})
    rows = lines.select("value", kept.alias("r"))
    counts = rows.agg(F.count("*").alias("n"), F.count("r._bad").alias("bad"), F.min(F.when(F.col("r._bad").isNotNull(), F.col("value"))).alias("line")).first()
    if not counts.n:
        raise SchemaError(f"{path}: contains no records")
    if counts.bad:
        raise SchemaError(f"{path}: {counts.bad} invalid lines, one is {counts.line[:80]!r}")
    return rows.select("r.*").drop("_bad")


def as_box(obb: Column) -> Column:
    return F.struct(*[F.get(obb, F.lit(i)).alias(k) for i, k in enumerate(("cx", "cy", "w", "h", "theta"))])


def violations(rows: DataFrame, detections: bool) -> DataFrame:
    """image_id, problem: what is wrong with array-boxed records; empty if they are sound."""
    obb = F.col("obb")
    problems = [
        (F.col("image_id").isNull(), "image_id missing"), (F.col("class").isNull(), "class missing"), (obb.isNull() | (F.size(obb) != 5), "obb needs five values"),
        (F.coalesce(F.exists(obb, lambda x: x.isNull()), F.lit(False)), "obb not numeric"), (F.coalesce((F.get(obb, F.lit(2)) < 0) | (F.get(obb, F.lit(3)) < 0), F.lit(False)), "negative side"),
    ]
    if detections:
        problems.append((F.col("score").isNull(), "score missing"))
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in problems]))
    return rows.select("image_id", F.explode(found).alias("problem"))


def checked(rows: DataFrame, detections: bool) -> DataFrame:
    """Sound records with struct boxes and scene ids filled from image names; anything wrong raises."""
    wrong = violations(rows, detections).limit(1).collect()
    if wrong:
        raise SchemaError(f"{wrong[0].image_id}: {wrong[0].problem}")
    return rows.withColumn("obb", as_box(F.col("obb"))).withColumn("scene_id", filled_scene(F.col("scene_id"), F.col("image_id")))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return checked(read_lines(spark, path, DETECTION), True)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return checked(read_lines(spark, path, TRUTH), False)


def with_index(rows: DataFrame) -> DataFrame:
    """idx: the position of a record within its image, by class, score and box."""
    from pyspark.sql import Window

    keys = [F.col("class"), *([F.col("score").desc()] if "score" in rows.columns else []), "obb"]
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy(*keys)).cast("bigint"))


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line; the writer's commit makes the folder appear whole."""
    rows.write.mode("overwrite").json(path)


def require_scenes(rows: DataFrame) -> DataFrame:
    if rows.agg(F.count("scene_id")).first()[0] == 0:
        raise SchemaError("no record has a scene id")
    return rows


def strict_numbers(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns without non-finite numbers, and a map ``nonfinite`` that says what stood there."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    kept = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.when(bad(c), F.col(c).cast("string")) for c in columns])), lambda k, v: v.isNotNull())
    out = rows.withColumn("nonfinite", kept)
    for c in columns:
        out = out.withColumn(c, F.when(~bad(c), F.col(c)))
    return out
