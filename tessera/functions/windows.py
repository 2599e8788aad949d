"""Sliding tile windows over pictures, and the boxes that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def starts(length: Column, size: int, stride: int) -> Column:
    """Window origins along one side; the last is shifted so that it ends with the picture."""
    n = F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / stride) + 1).cast("int")
    last = F.greatest(length - size, F.lit(0))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(i * stride, last).cast("int"))


def tile_windows(pictures: DataFrame, size: int = 1024, stride: int = 512, inside: float = 0.6, near: float = 0.01) -> DataFrame:
    """picture, x0, y0, share: windows of which more than ``inside`` lies in the picture, else those within ``near`` of the best share."""
    rows = pictures.select("picture", "width", "height", F.explode(F.array_distinct(starts(F.col("width"), size, stride))).alias("x0")).withColumn("y0", F.explode(F.array_distinct(starts(F.col("height"), size, stride))))
    w = F.least(F.lit(size), F.col("width") - F.col("x0"))
    h = F.least(F.lit(size), F.col("height") - F.col("y0"))
    rows = rows.withColumn("share", (w * h) / float(size * size))
    best = F.max("share").over(Window.partitionBy("picture"))
    return rows.withColumn("best", best).where((F.col("share") > inside) | ((F.col("best") <= inside) & (F.col("share") >= F.col("best") - near))).select("picture", "x0", "y0", "share")
