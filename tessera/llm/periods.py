"""Periodic runs of words, found by comparing the word ids with themselves at every lag.

A run is a stretch of words with smallest period q, of at least TIMES periods and LEAST words, that no neighbouring word
extends. At lag q it is a stretch of ``length - q`` equal comparisons. Every lag up to a text's share of words is compared,
first on a grid so fine that no long enough stretch holds fewer than GRID points of it, then, where that many points in a
row agree, word by word; the true stretches are run-length coded. A stretch at a multiple of the period of a run that is
known is the same run unless a neighbouring word extends it, so it is looked at but not compared again.

The texts of a batch stand one after another, longest first, with ids that differ between texts: one comparison serves them
all. Texts above ``long_bytes`` are dealt to the machines by ranges of lags, and the runs of all ranges are put together.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, free, frugal, session, stored
from .words import chunks

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3
#: Points of the grid in each stretch that is long enough.
GRID = 4
#: Texts above so many bytes are dealt by ranges of so many lags.
LONG_BYTES, LAGS = 1 << 20, 1 << 16
#: White space, as bytes.split() has it.
BLANKS = " \t\n\x0b\f\r"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _smallest(w: np.ndarray, start: int, lag: int) -> int:
    """The smallest period of the run at ``start`` that has period ``lag`` three times: one of its divisors."""
    one = w[start : start + lag]
    small = [d for d in range(1, int(lag**0.5) + 1) if lag % d == 0]
    for d in sorted({*small, *(lag // d for d in small)}):
        if w[start] == w[start + d] and np.array_equal(one, w[start + d : start + d + lag]):
            return d
    return lag


def runs_of(ids: list[np.ndarray], first: int = 1, last: int | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text (an array of word ids) its runs (start, length, period) by start, then period.

    With ``first`` and ``last`` only those that lags of that range show; the ranges together show all.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    lengths = np.array([len(x) for x in ids], np.int64)
    order = [k for k in np.argsort(-lengths, kind="stable").tolist() if lengths[k] >= LEAST]
    if not order:
        return out
    w = np.concatenate([ids[k].astype(np.int64) * len(ids) + k for k in order])
    falling, starts = -lengths[order], np.concatenate([[0], np.cumsum(lengths[order])])
    known: set[tuple[int, int]] = set()
    due: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for q in count(first):
        texts = int(np.searchsorted(falling, -max(LEAST, TIMES * q), side="right"))
        if not texts or last and q > last:
            break
        end = int(starts[texts])
        again = sorted(due.pop(q, ()))
        for b, e, p in again:
            if TIMES * (q + p) <= e - b:
                due[q + p].append((b, e, p))
        least = max(LEAST - q, (TIMES - 1) * q)
        step = max(1, least // GRID)
        need = min(GRID, least // step)
        hit = w[: end - q : step] == w[q:end:step]
        most = len(hit) - need + 1
        if most <= 0:
            continue
        near = hit[:most].copy()
        for j in range(1, need):
            near &= hit[j : most + j]
        at = np.flatnonzero(near)
        if not len(at):
            continue
        new = np.flatnonzero(np.diff(at) > 1)
        for g, h in zip(at[np.append(0, new + 1)].tolist(), (at[np.append(new, len(at) - 1)] + need - 1).tolist()):
            i = bisect_right(again, (g * step, len(w) + 1, 0)) - 1
            if i >= 0:
                b, e, _ = again[i]
                grows = b > 0 and w[b - 1] == w[b - 1 + q] or e < len(w) and w[e] == w[e - q]
                if e >= h * step + q + 1 and not grows:
                    continue
            lo, hi = max(0, (g - 1) * step + 1), min(end - q, (h + 1) * step)
            same = np.zeros(hi - lo + 2, np.int8)
            same[1:-1] = w[lo:hi] == w[lo + q : hi + q]
            edge = np.flatnonzero(np.diff(same))
            for x, y in zip((edge[::2] + lo).tolist(), (edge[1::2] + lo + q).tolist()):
                if y - x - q >= least and (x, y) not in known:
                    known.add((x, y))
                    p = _smallest(w, x, q)
                    following = (q // p + 1) * p
                    if TIMES * following <= y - x:
                        due[following].append((x, y, p))
                    k = int(np.searchsorted(starts, x, side="right")) - 1
                    out[order[k]].append((x - int(starts[k]), y - x, p))
    for rows in out:
        rows.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run only those of its first period."""
    if not runs:
        return b" ".join(words)
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])


def _words(texts: list[bytes | None]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    number: dict[bytes, int] = defaultdict(count().__next__)
    words = [t.split() if t else [] for t in texts]
    return words, [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in words]


def _struct(runs: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "length": n, "period": p} for s, n, p in runs]


def _work(lists):
    for texts in lists:
        for lo, hi in chunks(texts):
            words, ids = _words(texts[lo:hi])
            found = runs_of(ids)
            yield range(lo, hi), {"runs": list(map(_struct, found)), "collapsed": [collapsed(ws, rs) for ws, rs in zip(words, found)]}


@frugal
def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of long texts by their ranges of lags."""
    for b in batches:
        for key, first, last, text in zip(*(c.to_pylist() for c in b.columns)):
            found = runs_of(_words([text])[1], first, last)[0]
            yield pa.RecordBatch.from_pydict({"row": pa.array([key] * len(found), pa.int64()), **{n: pa.array([r[i] for r in found], pa.int64()) for i, n in enumerate(("start", "length", "period"))}})


@frugal
def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, runs and text, become runs and collapsed text."""
    for b in batches:
        found, texts = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        short = [collapsed(t.split(), [(r["start"], r["length"], r["period"]) for r in rs]) for rs, t in zip(found, texts)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(short, pa.string())], names=[*b.schema.names[:-1], "collapsed"])


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.translate(text, BLANKS, ""))


def periodic_runs(docs: DataFrame, long_bytes: int = LONG_BYTES, lags: int = LAGS) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``runs`` (start, length and period in words) and ``collapsed`` per row.

    One row per row of ``docs``, repeated rows too. Null and empty texts have no run and an empty collapsed text; words are
    parted by ASCII white space and compared byte by byte. A collapsed text keeps a word unless some run holds it behind the
    run's first period. Neither result depends on ``long_bytes`` and ``lags``. Columns named ``runs`` or ``collapsed`` are
    not kept. A text, its words and their ids are in one task's memory at once.
    """
    session(docs.sparkSession)
    docs = docs.drop("runs", "collapsed")
    raw = F.col("text").cast("binary")
    long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    short = beside(docs.where(~long).withColumn("text", raw), _work, f"runs {RUNS}, collapsed string")
    row, unit = free(docs, "row", "unit")
    rest = stored(docs.where(long).withColumn(row, F.monotonically_increasing_id()), "long_texts")
    if rest.isEmpty():
        return short
    units = rest.withColumn(unit, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((_blanks(F.col("text")) + 1) / (TIMES * lags)))))
    dealt = units.repartition(F.col(row), F.col(unit)).select(row, (F.col(unit) * lags + 1).alias("first"), ((F.col(unit) + 1) * lags).alias("last"), raw.alias("text"))
    found = dealt.mapInArrow(_ranges, "row long, start long, length long, period long").distinct()
    merged = found.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    whole = rest.join(merged, row, "left").select(*[c for c in docs.columns if c != "text"], F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), raw.alias("text"))
    made = whole.mapInArrow(_put_together, short.schema)
    return short.unionByName(made)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of the runs and the collapsed text."""
    best = F.expr("aggregate(slice(runs, 2, size(runs)), try_element_at(runs, 1), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of a tenth of the texts, by crc32 of the id, made periodic from a word on that the same hash picks."""
    words = "filter(split(text, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), x -> x != '')"
    g, first = "(crc32(cast(cast(doc_id as string) as binary)) div 10)", "({g} % size(ws))"
    word = f"ws[int(if(i < {first}, i, {first} + (i - {first}) % (1 + (size(ws) - {first}) div (3 + {{g}} % 8))))]".format(g=g)
    # The words are bound once, as an element of an array, so no plan splits the text again for each of them.
    text = f"transform(array({words}), ws -> if(size(ws) > 0, array_join(transform(sequence(0, size(ws) - 1), i -> {word}), ' '), text))[0]"
    return docs.withColumn("text", F.expr(f"case when crc32(cast(cast(doc_id as string) as binary)) % 10 = 0 and text is not null then {text} else text end"))
