"""Greedy matching of cells over a stream: a cell is kept until it is complete, then settled once; what comes later is told apart.

The candidates of a cell (an image and a class) may come in any order and over any number of batches. The row that says
``last`` closes its cell by stating how many candidates it has; when all are there, the state is folded as the batch operator
folds sorted candidates, and is dropped but for a mark. Rows of a settled cell are its late rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ["image_id", "class"]
MATCH, LATE = "match", "late"
_CANDIDATE = "det_idx long, score double, gt_idx long, iou double"
OUT = f"image_id string, class string, kind string, {_CANDIDATE}"


def settled(rows: list[tuple[int, float, int, float]]) -> list[tuple[int, float, int, float]]:
    """Matches of a cell: by falling score, then detection, falling overlap and object; each takes part once."""
    dets, gts, out = set(), set(), []
    for det, score, gt, iou in sorted(rows, key=lambda r: (-r[1], r[0], -r[3], r[2])):
        if det not in dets and gt not in gts:
            dets.add(det)
            gts.add(gt)
            out.append((det, score, gt, iou))
    return out


class GreedyCell(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("candidates", _CANDIDATE)
        self.want = handle.getValueState("want", "n long")
        self.done = handle.getValueState("done", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh, wanted = [], None
        for b in rows:
            ends = b[b["last"]]
            if len(ends):
                wanted = int(ends.n.iloc[0])
            own = b[~b["last"]]
            fresh += list(zip(own.det_idx.tolist(), own.score.tolist(), own.gt_idx.tolist(), own.iou.tolist()))
        if self.done.exists():
            if fresh:
                yield self.told(key, LATE, fresh)
            return
        if wanted is not None:
            self.want.update((wanted,))
        for r in fresh:
            self.rows.appendValue(r)
        if self.want.exists():
            every = [(int(r[0]), float(r[1]), int(r[2]), float(r[3])) for r in self.rows.get()]
            if len(every) >= int(self.want.get()[0]):
                self.done.update((len(every),))
                self.rows.clear()
                self.want.clear()
                found = settled(every)
                if found:
                    yield self.told(key, MATCH, found)

    @staticmethod
    def told(key, kind: str, rows: list[tuple[int, float, int, float]]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["det_idx", "score", "gt_idx", "iou"])
        out.insert(0, "kind", kind)
        out.insert(0, "class", key[1])
        out.insert(0, "image_id", key[0])
        return out

    def close(self) -> None:
        pass


def greedy_cells(rows: DataFrame) -> DataFrame:
    """image_id, class, kind ('match' or 'late'), det_idx, score, gt_idx, iou of a stream of candidates.

    ``rows``: image_id, class, last, n, det_idx, score, gt_idx, iou; a row with ``last`` carries only the number n of its
    cell's candidates. A cell of n = 0 gives nothing. Cells never closed give nothing and stay in the state; a settled
    cell keeps one number. The state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    return rows.groupBy(*KEYS).transformWithStateInPandas(GreedyCell(), OUT, "append", "none")


def with_ends(candidates: DataFrame) -> DataFrame:
    """The rows of ``greedy_cells`` for a table of candidates: each, and an end for every cell."""
    own = candidates.select(*KEYS, F.lit(False).alias("last"), F.lit(0).cast("long").alias("n"), "det_idx", "score", "gt_idx", "iou")
    ends = candidates.groupBy(*KEYS).agg(F.count("*").alias("n")).select(*KEYS, F.lit(True).alias("last"), "n", *[F.lit(0).cast(t).alias(c) for c, t in (("det_idx", "long"), ("score", "double"), ("gt_idx", "long"), ("iou", "double"))])
    return own.unionByName(ends)


def split_output(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches, and the late rows beside them."""
    part = lambda kind: found.where(F.col("kind") == kind).drop("kind")
    return part(MATCH), part(LATE)
