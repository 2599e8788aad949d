"""Session settings, shared scratch tables and small helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import forgotten, scratch_path, stored  # noqa: F401

#: Bytes of one Arrow batch. Rows of few bytes travel by the thousand, very long texts alone.
BATCH_BYTES = 1 << 19


def tidy() -> None:
    """Give freed memory back to the system: idle workers and the driver share the machine with others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(f):
    """A batch function that gives its memory back when its task ends."""

    @functools.wraps(f)
    def run(batches, *args, **more):
        try:
            yield from f(batches, *args, **more)
        finally:
            tidy()

    return run


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of Python stages by bytes; their rows stay as the cluster set them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def kept(key, make: Callable):
    """What ``make`` gave for ``key`` in this Python worker: functions travel by value, so their own globals do not last between tasks."""
    store = sys.__dict__.setdefault("_tessera_kept", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


def free(rows: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to differ from every column of ``rows``."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def beside(rows: DataFrame, work: Callable[[list], Iterable[tuple[list, dict]]], added: str) -> DataFrame:
    """The columns of ``rows`` but ``text``, with the columns ``added`` that ``work`` makes of the texts.

    ``work`` is called once a task with an iterator over lists of texts, and yields for parts of them, in order, (places in
    the list that is current, columns). The other columns stay in Arrow, so nulls and large numbers keep their values.
    """
    own = rows.select(*[c for c in rows.columns if c != "text"], "text")
    kinds = StructType.fromDDL(added)
    shape = StructType(own.schema.fields[:-1] + kinds.fields)
    made = to_arrow_schema(kinds)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list[pa.RecordBatch] = []

        def texts():
            for b in batches:
                current[:] = [b]
                yield b.column(b.num_columns - 1).to_pylist()

        for places, columns in work(texts()):
            b = current[0]
            at = pa.array(places, pa.int64())
            left = [c.take(at) for c in b.columns[:-1]]
            right = [columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in made]
            yield pa.RecordBatch.from_arrays(left + right, names=[f.name for f in shape.fields])

    return own.mapInArrow(run, shape)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, base: int):
    """crc32 of an id written as text, modulo ``base``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(base))
