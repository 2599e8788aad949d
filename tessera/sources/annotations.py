"""Readers of public annotation formats into ground-truth boxes."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import rectangle_of
from ..functions.boxes import from_rotated_box
from ..functions.names import class_name


class AnnotationError(ValueError):
    """An annotation without a recognisable oriented box."""


def _image(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def dota_text(spark: SparkSession, path: str, strict_classes: list[str] | None = None, most_difficult: int = 100) -> DataFrame:
    """image_id, class, difficult, obb from lines of eight coordinates, a class and a difficulty.

    The lenient form takes the ninth token as the class and skips lines that are short or not numeric. With
    ``strict_classes`` a class may hold blanks, an unknown one raises and harder objects are dropped.
    """
    lines = spark.read.text(path).select(_image(F.col("_metadata.file_path")).alias("image_id"), F.split(F.trim("value"), r"\s+").alias("t"))
    lines = lines.where(F.size("t") >= (10 if strict_classes else 9)).withColumn("xy", F.transform(F.slice("t", 1, 8), lambda v: v.try_cast("double")))
    lines = lines.where(~F.exists("xy", lambda v: v.isNull()))
    if strict_classes:
        name = F.array_join(F.expr("slice(t, 9, size(t) - 9)"), " ")
        hard = F.element_at("t", -1).try_cast("int")
        known = F.when(name.isin(strict_classes), name).otherwise(F.raise_error(F.concat(F.lit("unknown class "), name)))
        rows = lines.select("image_id", known.alias("class"), hard.alias("difficult"), "xy").where(F.col("difficult") <= most_difficult)
    else:
        rows = lines.select("image_id", F.col("t")[8].alias("class"), F.coalesce(F.get("t", F.lit(9)).try_cast("int"), F.lit(0)).alias("difficult"), "xy")
    return rows.withColumn("obb", rectangle_of(F.col("xy"))).drop("xy")


_CORNERS = [("x_left_top", "y_left_top", "x_right_top", "y_right_top", "x_right_bottom", "y_right_bottom", "x_left_bottom", "y_left_bottom"), tuple(f"{a}{i}" for i in range(1, 5) for a in "xy"), tuple(f"{a}{i}" for i in range(4) for a in "xy")]


def _fields(names) -> str:
    return ", ".join(f"{n}: string" for n in names)


_BOXES = sorted({n for s in _CORNERS for n in s})
_OBJECT = f"name string, difficult string, robndbox struct<cx: string, cy: string, w: string, h: string, angle: string, {_fields(_BOXES)}>, polygon struct<{_fields(_BOXES)}>, bndbox struct<xmin: string>, {', '.join(f'{n} string' for n in _BOXES)}"


def _numbers(prefix: str, names) -> Column:
    values = F.array(*[F.expr(f"{prefix}{n}").try_cast("double") for n in names])
    return F.when(~F.exists(values, lambda v: v.isNull()), values)


def dior_xml(spark: SparkSession, path: str, degrees: bool = False, skip_without: bool = False) -> DataFrame:
    """image_id, class, difficult, obb from XML objects.

    Five parameters of a rotated box come first, then eight corners in it, in a polygon or in the object. Objects with
    neither raise, or are left out with ``skip_without``. Classes are lower-cased.
    """
    rows = spark.read.format("xml").option("rowTag", "object").option("attributePrefix", "_").schema(_OBJECT).load(path).select("*", _image(F.col("_metadata.file_path")).alias("image_id"))
    five = _numbers("robndbox.", ("cx", "cy", "w", "h", "angle"))
    eight = F.coalesce(*[_numbers(p, s) for p in ("robndbox.", "polygon.", "") for s in _CORNERS])
    rows = rows.select("image_id", class_name(F.col("name")).alias("class"), F.coalesce(F.nullif("difficult", F.lit("")).try_cast("int"), F.lit(0)).alias("difficult"), five.alias("five"), eight.alias("xy"))
    direct = from_rotated_box(*[F.col("five")[i] for i in range(5)], degrees=degrees)
    rows = rows.where("five is not null or xy is not null") if skip_without else rows.withColumn("class", F.when(F.expr("five is null and xy is null"), F.raise_error(F.concat(F.lit("no oriented box: "), "class"))).otherwise(F.col("class")))
    turned = rows.withColumn("obb", F.when(F.col("five").isNotNull(), direct).otherwise(rectangle_of(F.coalesce("xy", F.array(*[F.lit(0.0)] * 8)))))
    return turned.select("image_id", "class", "difficult", "obb")


def hrsc_xml(spark: SparkSession, path: str) -> DataFrame:
    """image_id, class, obb of objects with a rotated box; others are skipped."""
    return dior_xml(spark, path, degrees=False, skip_without=True).drop("difficult")


def corner_lines(boxes: DataFrame) -> DataFrame:
    """image_id, line: 'x1 y1 ... x4 y4 class difficulty' with corners in turn, as text annotations have them."""
    from ..functions.boxes import canonical, corners

    points = [F.call_function("format_number", v, F.lit("0.0###")) for xy in corners(canonical(F.col("obb"))) for v in xy]
    return boxes.select("image_id", F.concat_ws(" ", *points, F.replace("class", F.lit(" "), F.lit("-")), F.lit("0")).alias("line"))


def coco_json(spark: SparkSession, path: str) -> DataFrame:
    """image_id, file_name, class, annotation_id, x, y, w, h from a COCO file; repeated ids and dangling references raise."""
    doc = spark.read.option("multiLine", True).schema(
        "images array<struct<id: bigint, file_name: string, width: int, height: int>>, categories array<struct<id: bigint, name: string>>,"
        "annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, bbox: array<double>, segmentation: array<array<double>>>>"
    ).json(path)
    part = lambda c: doc.select(F.explode(c).alias("e")).select("e.*")
    images, kinds, notes = part("images"), part("categories"), part("annotations")
    for name, table in (("image", images), ("category", kinds), ("annotation", notes)):
        if not table.groupBy("id").count().where("count > 1").isEmpty():
            raise AnnotationError(f"repeated {name} id")
    joined = notes.withColumnRenamed("id", "annotation_id").join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id", "left")
    joined = joined.join(F.broadcast(kinds.select(F.col("id").alias("category_id"), F.col("name").alias("class"))), "category_id", "left")
    if not joined.where("file_name is null or class is null").isEmpty():
        raise AnnotationError("an annotation refers to an unknown image or category")
    return joined.select("image_id", "file_name", class_name(F.col("class")).alias("class"), "annotation_id", *[F.col("bbox")[i].alias(k) for i, k in enumerate("xywh")])


def collinear(xy: Column) -> Column:
    """Whether eight decimal coordinates (as text) enclose no area, by exact decimals."""
    d = lambda i: F.get(xy, F.lit(i)).cast("decimal(18,6)")
    cross = [(d(2 * a) - d(0)) * (d(2 * b + 1) - d(1)) - (d(2 * a + 1) - d(1)) * (d(2 * b) - d(0)) for a, b in ((1, 2), (1, 3), (2, 3))]
    return (cross[0] == 0) & (cross[1] == 0) & (cross[2] == 0)


def exclusions(rows: DataFrame, limit: int = 100) -> DataFrame:
    """rows with reasons: why an annotation (xy as text, difficult) is left out; empty where it stays."""
    why = F.array(F.when(collinear(F.col("xy")), F.lit("zero_area")), F.when(F.col("difficult") > limit, F.lit("difficult")))
    return rows.withColumn("reasons", F.array_compact(why))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, bytes, sha256 of every file in ZIP archives."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(batches):
        for b in batches:
            for name, data in zip(b.path, b.content):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    yield pd.DataFrame([(name, m.filename, z.read(m)) for m in z.infolist() if not m.is_dir()], columns=["archive", "member", "content"])

    return files.mapInPandas(members, "archive string, member string, content binary").select("archive", "member", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def strict_json(text: str):
    """A JSON document without repeated keys and non-finite numbers."""

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(keys) != len(set(keys)):
            raise AnnotationError("repeated key")
        return dict(pairs)

    def never(x):
        raise AnnotationError(f"non-finite number {x}")

    return json.loads(text, object_pairs_hook=once, parse_constant=never)


def logits_to_detections(logits: DataFrame, k: int = 300) -> DataFrame:
    """tile, query, label, score: the k best (query, class) cells of each tile by sigmoid, earlier cells first on ties.

    ``logits``: tile, query, logits array<double>.
    """
    from pyspark.sql import Window

    from ..functions.boxes import sigmoid

    cells = logits.select("tile", "query", F.posexplode("logits").alias("label", "x")).withColumn("score", sigmoid(F.col("x")))
    w = Window.partitionBy("tile").orderBy(F.col("score").desc(), "query", "label")
    return cells.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("tile", "query", "label", "score")


def shard_problems(shards: DataFrame, tiles: DataFrame, n_shards: int) -> DataFrame:
    """problem, n: tiles in the wrong shard, repeated, missing or unknown. ``shards``: shard, tile_index; ``tiles``: tile_index."""
    wrong = shards.where(F.pmod("tile_index", F.lit(n_shards)) != F.col("shard")).agg(F.count("*").alias("n")).select(F.lit("wrong shard").alias("problem"), "n")
    twice = shards.groupBy("tile_index").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated tile").alias("problem"), "n")
    gone = tiles.join(shards, "tile_index", "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing tile").alias("problem"), "n")
    odd = shards.join(tiles, "tile_index", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown tile").alias("problem"), "n")
    return wrong.unionByName(twice).unionByName(gone).unionByName(odd).where("n > 0")


