"""Exact thresholds of many levels, coordinates and draws without sorting the values: two passes of histograms.

Cuts come from a sample, and only say where bins end. A first pass adds up the masses of all bins, which tells the bin of each
level's threshold; a second one takes the values of those bins alone, and there the running mass finds the threshold itself.
Groups are numbered; sums of groups are what a task returns, whatever its number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = math.inf
#: Bins over all values, and as many more over the upper tail that holds the thresholds.
EVEN, TAIL = 256, 768
#: Rows of a part of the values that the second pass sorts.
PART = 1_000_000
#: A wanted threshold: which running mass (0 shares, 1 objects) must reach what.
Want = tuple[int, float]


def cuts_of(values: np.ndarray, tail: float) -> np.ndarray:
    """Rising ends of bins for values of which the largest ``tail`` (a share) matter."""
    v = np.sort(values[np.isfinite(values)])
    if not len(v):
        return np.empty(0)
    at = np.concatenate([np.linspace(0, 1, EVEN), np.linspace(1 - min(1.0, tail), 1, TAIL)])
    return np.unique(v[np.minimum((at * len(v)).astype(np.int64), len(v) - 1)])


def summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """g -> the sum of the arrays (bytes of doubles) of ``rows`` (g int, x binary); added up by tasks before they are collected."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for g, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_buffer(), float)
                total[g] = total[g] + x if g in total else x.copy()
        yield blobs(total)

    return {r.g: np.frombuffer(r.x, float) for r in rows.repartition("g").mapInArrow(add, "g int, x binary").collect()}


def blobs(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["g", "x"])


#: Of a batch: (group, values, shares of a scene's mass, objects) for every group that has rows in it.
Parts = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]


def histograms(rows: DataFrame, parts: Parts, cuts: Callable[[int], np.ndarray]) -> dict[int, np.ndarray]:
    """g -> masses (2, bins) of shares and objects."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for g, v, share, objects in parts(b):
                c = cuts(g)
                at = np.searchsorted(c, v)
                held = np.stack([np.bincount(at, w, len(c) + 1) for w in (share, objects)])
                total[g] = total[g] + held if g in total else held
        yield blobs(total)

    return {g: x.reshape(2, -1) for g, x in summed(rows.mapInArrow(count, "g int, x binary")).items()}


def found(rows: DataFrame, parts: Parts, cuts: Callable[[int], np.ndarray], wants: Callable[[int, float, int], list[Want]]) -> dict[int, np.ndarray]:
    """g -> thresholds: for each of ``wants(g, scenes, objects)`` the smallest value whose running mass reaches it; +inf where none does.

    Groups without a row are absent.
    """
    held = histograms(rows, parts, cuts)
    need: dict[int, np.ndarray] = {}
    asked: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, list]] = {}
    out: dict[int, np.ndarray] = {}
    taken = 0.0
    for g, mass in held.items():
        run = np.cumsum(mass, axis=1)
        every = wants(g, float(np.rint(run[0, -1])), int(run[1, -1]))
        out[g] = np.full(len(every), INF)
        need[g] = np.zeros(mass.shape[1], bool)
        for i, (kind, least) in enumerate(every):
            b = int(np.searchsorted(run[kind], least))
            if b < mass.shape[1]:
                need[g][b] = True
                asked.setdefault((g, b), (run[:, b] - mass[:, b], run[:, b], []))[2].append((i, kind, least))
        taken += mass[1][need[g]].sum()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [], [], [], [], []
            for g, v, share, objects in parts(b):
                if g not in need:
                    continue
                at = np.searchsorted(cuts(g), v)
                ok = need[g][at]
                if ok.any():
                    for c, x in zip(cols, (np.full(ok.sum(), g, np.int32), at[ok].astype(np.int32), v[ok], share[ok], objects[ok])):
                        c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["g", "b", "v", "s", "c"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not read:
            return
        g, b, v, s, c = (x.to_numpy() for x in pa.concat_tables(read).columns)
        begin = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (b[1:] != b[:-1])))
        got = [], [], []
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(g)]):
            base, _, wanted = asked[int(g[lo]), int(b[lo])]
            run = base[0] + np.cumsum(s[lo:hi]), base[1] + np.cumsum(c[lo:hi])
            for i, kind, least in wanted:
                at = min(int(np.searchsorted(run[kind], least)), hi - lo - 1)  # the bin reaches it; the last one if rounding hides that
                for x, y in zip(got, (int(g[lo]), i, float(v[lo + at]))):
                    x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(got, (pa.int32(), pa.int32(), pa.float64()))], ["g", "i", "q"])

    values = rows.mapInArrow(pick, "g int, b int, v double, s double, c double").groupBy("g", "b", "v").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    placed = values.repartition(max(8, math.ceil(taken / PART)), "g", "b").sortWithinPartitions("g", "b", "v")
    for r in placed.mapInArrow(resolve, "g int, i int, q double").collect():
        out[r.g][r.i] = r.q
    return out
