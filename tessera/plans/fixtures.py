"""Detection-shaped tables derived from the order tables by integer arithmetic.

The same expressions are valid for Spark and for other SQL engines, so results can be compared.
An order is a scene, an order line an object; the predicted box is the true one with small offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import box

SEED = "(l_orderkey * 1000003 + l_partkey * 10007 + l_suppkey * 101 + l_linenumber * 7 + cast(l_quantity as bigint)) % 1000003"
#: Bytes of a generated method beyond which the JVM would interpret it; Spark then makes smaller methods, operator by operator.
COMPILED = 8000
#: name -> expression over lineitem and z, the row's seed.
COLUMNS = {
    "scene_id": "concat('S', lpad(cast(l_orderkey as varchar(20)), 9, '0'))",
    "image_id": "concat('S', lpad(cast(l_orderkey as varchar(20)), 9, '0'), '__1024__', cast(l_linenumber % 2 as varchar(20)), '___0')",
    "class": "l_returnflag",
    "idx": "(cast(l_linenumber as bigint) * 10000000000000 + l_partkey * 1000000 + l_suppkey) * 100 + cast(l_quantity as bigint)",
    "gx": "cast((l_orderkey * 37) % 1000 + (l_linenumber % 3) * 6 + z % 5 as double)",
    "gy": "cast((l_orderkey * 91) % 1000 + (l_linenumber % 2) * 5 + z % 7 as double)",
    "gw": "10.0e0 + cast(l_quantity as double)",
    "gh": "cast(4 + z % 9 as double)",
    "gt": "cast((z * 31) % 3142 as double) / 1000.0e0 - pi() / 2.0e0",
    "px": "cast((l_orderkey * 37) % 1000 + (l_linenumber % 3) * 6 + z % 5 as double) + cast((z * 17) % 11 - 5 as double) * 0.4e0",
    "py": "cast((l_orderkey * 91) % 1000 + (l_linenumber % 2) * 5 + z % 7 as double) + cast((z * 13) % 9 - 4 as double) * 0.3e0",
    "pw": "(10.0e0 + cast(l_quantity as double)) * (1.0e0 + cast((z * 7) % 9 - 4 as double) * 0.02e0)",
    "ph": "cast(4 + z % 9 as double) * (1.0e0 + cast((z * 11) % 7 - 3 as double) * 0.03e0)",
    "pt": "cast((z * 31) % 3142 as double) / 1000.0e0 - pi() / 2.0e0 + cast((z * 5) % 21 - 10 as double) * 0.02e0",
    "score": "cast((z * 7919) % 951 + 50 as double) / 1000.0e0",
    "has_det": "z % 10 <> 0",
    "has_gt": "z % 11 <> 0",
    "role": "case when (l_orderkey * 7919) % 10 < 4 then 'cal' when (l_orderkey * 7919) % 10 < 6 then 'design' else 'eval' end",
}


def base_sql() -> str:
    """The objects as a query over the view ``lineitem``."""
    cols = ", ".join(f'{v} as "{k}"' for k, v in COLUMNS.items())
    return f"(select {cols} from (select *, {SEED} as z from lineitem) s)"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per object: scene_id, image_id, class, idx, gt, pred, score, has_det, has_gt, role."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("z", F.expr(SEED))
    rows = line.select(*[F.expr(v).alias(k) for k, v in COLUMNS.items()])
    keep = ["scene_id", "image_id", "class", "idx", "score", "has_det", "has_gt", "role"]
    return rows.select(*keep, box(*[F.col(c) for c in ("px", "py", "pw", "ph", "pt")]).alias("pred"), box(*[F.col(c) for c in ("gx", "gy", "gw", "gh", "gt")]).alias("gt"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with both boxes: matched pairs known by construction."""
    return objects(spark, sf_dir).where("has_det and has_gt").drop("has_det", "has_gt")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).where("has_det").select("image_id", "scene_id", "class", "idx", F.col("pred").alias("obb"), "score")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).where("has_gt").select("image_id", "scene_id", "class", "idx", F.col("gt").alias("obb"))
