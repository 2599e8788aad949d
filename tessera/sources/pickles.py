"""Pickled detector outputs as detection rows, through an unpickler that makes nothing but arrays and plain containers."""

from __future__ import annotations

import io
import pickle
from collections import OrderedDict
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.arrow import smallest_rectangle
from .scratch import stored

#: Names that a file may ask for, whatever module of numpy they are in. All others are refused before they are looked up.
ARRAYS = frozenset({"_reconstruct", "scalar", "ndarray", "dtype", "_frombuffer"})


class RefusedPickle(ValueError):
    """A file asks for something that is neither an array nor a plain container."""


def _bytes(text: str, coding: str) -> bytes:
    """How old protocols write bytes."""
    if coding != "latin1":
        raise RefusedPickle(f"text coded as {coding} is refused")
    return text.encode("latin1")


class ArrayUnpickler(pickle.Unpickler):
    """Builds numbers, text, containers and numpy arrays of plain types; object arrays and everything else are refused."""

    def find_class(self, module: str, name: str):
        top = module.split(".")[0]
        if top == "numpy" and name in ARRAYS:
            if name in ("ndarray", "dtype"):
                return getattr(np, name)
            from numpy._core import multiarray, numeric

            return getattr(multiarray if name != "_frombuffer" else numeric, name)
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if (module, name) == ("_codecs", "encode"):
            return _bytes
        raise RefusedPickle(f"{module}.{name} is refused")

    def persistent_load(self, pid):
        raise RefusedPickle("a reference to outside the file is refused")


def loads(data: bytes):
    try:
        return ArrayUnpickler(io.BytesIO(data)).load()
    except RefusedPickle:
        raise
    except Exception as e:  # noqa: BLE001  a damaged file can fail in any way
        raise RefusedPickle(f"not a readable file: {type(e).__name__}: {e}") from None


def _image(sample: dict) -> str:
    meta = sample.get("metainfo") or {}
    for key in ("img_path", "img_id"):
        for held in (sample, meta):
            if held.get(key) not in (None, ""):
                return PurePosixPath(str(held[key]).replace("\\", "/")).stem
    raise RefusedPickle("a sample names no image")


def _array(values, width: int | None, what: str) -> np.ndarray:
    out = np.asarray(values)
    if out.dtype.kind not in "iuf":
        if out.size:
            raise RefusedPickle(f"{what} are not numbers")
        out = out.astype(float)
    out = out.astype(float)
    if width is None:
        return out.reshape(-1)
    if not out.size:
        return np.empty((0, 5))
    if out.ndim != 2 or out.shape[1] not in (5, 8):
        raise RefusedPickle(f"{what} must have five or eight columns")
    return out


def samples_of(data: bytes, classes: list[str]) -> Iterator[tuple[str, list[dict]]]:
    """(image_id, detections) of every sample of a file: class, x, y, w, h, angle, score. Any fault is an error."""
    loaded = loads(data)
    if not isinstance(loaded, (list, tuple)):
        raise RefusedPickle("a file holds a list of samples")
    for sample in loaded:
        if not isinstance(sample, dict) or not isinstance(sample.get("pred_instances"), dict):
            raise RefusedPickle("a sample has no predictions")
        pred = sample["pred_instances"]
        if not {"bboxes", "labels", "scores"} <= pred.keys():
            raise RefusedPickle("predictions lack boxes, labels or scores")
        boxes, labels, scores = _array(pred["bboxes"], 5, "boxes"), _array(pred["labels"], None, "labels"), _array(pred["scores"], None, "scores")
        if not len(boxes) == len(labels) == len(scores):
            raise RefusedPickle("boxes, labels and scores differ in number")
        if not np.isfinite(boxes).all() or not (np.isfinite(scores) & (scores >= 0) & (scores <= 1)).all():
            raise RefusedPickle("a box is not finite or a score not within 0 and 1")
        if not ((labels == np.floor(labels)) & (labels >= 0) & (labels < len(classes))).all():
            raise RefusedPickle("a label is outside the classes")
        if boxes.shape[1] == 8:
            boxes = smallest_rectangle(boxes.reshape(-1, 4, 2))
        yield _image(sample), [{"class": classes[int(k)], "x": b[0], "y": b[1], "w": b[2], "h": b[3], "angle": b[4], "score": s} for b, k, s in zip(boxes.tolist(), labels, scores.tolist())]


def detections(spark: SparkSession, path: str, classes: list[str], floor: float = 0.05, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """file, image_id, class, obb (canonical), score of all samples of the files below ``path``, of scores ``floor`` or more.

    Boxes are (x, y, w, h, angle) or four corners, whose smallest rectangle is taken. A refused file, a damaged one, a fault
    in a sample, and an image that occurs twice, in one file or in two, are errors. A file is in one task's memory.
    """
    found = "array<struct<class:string,x:double,y:double,w:double,h:double,angle:double,score:double>>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("class", pa.string()), *[(n, pa.float64()) for n in ("x", "y", "w", "h", "angle", "score")]]))
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    images, every = zip(*list(samples_of(data, classes)) or [((), ())])
                except RefusedPickle as e:
                    raise RefusedPickle(f"{file}: {e}") from None
                if images != ((),):
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(images)), pa.array(images, pa.string()), pa.array(every, kind)], names=["file", "image_id", "found"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    images = stored(files.mapInArrow(read, f"file string, image_id string, found {found}"), "samples")
    twice = images.groupBy("image_id").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n > 1").orderBy("image_id").first()
    if twice:
        raise ValueError(f"image {twice.image_id} occurs {twice.n} times, first in {twice.file}")
    d = images.select("file", "image_id", F.explode("found").alias("d")).where(F.col("d.score") >= floor)
    p = B.canonical(B.box(F.col("d.x") + offset[0], F.col("d.y") + offset[1], F.col("d.w"), F.col("d.h"), F.col("d.angle")))
    return d.select("file", "image_id", "d.class", B.box(*[p[k] for k in ("cx", "cy", "w", "h", "theta")]).alias("obb"), "d.score")
