"""What the trained classifiers share: which labelled rows may teach, how to reach their texts, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, remainder

#: Bits per id of the filter that spares other texts a shuffle, and the most bits (as a power of 2; 16 MB).
FILTER_SHARE, MOST_BITS = 32, 27
#: Ids (with a label) that are broadcast at most, after a count: some tens of MB.
MOST_BROADCAST = 500_000
#: Rows from which a key is hot, and the most hot keys.
HOT, MOST_HOT = 1_000, 100_000


def logistic(x: np.ndarray, y: np.ndarray, shrink: float = 1e-2) -> tuple[float, float]:
    """Slope and level of P(y = 1) over x: Newton steps, halved until the shrunken likelihood grows."""
    middle, spread = float(np.mean(x)), float(np.std(x)) or 1.0
    a = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    loss = lambda t: float(np.logaddexp(0, -np.where(y > 0.5, 1, -1) * (a @ t)).sum() + shrink * t @ t / 2)
    theta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -500, 500)))
        gradient = a.T @ (y - p) - shrink * theta
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + shrink * np.eye(2), gradient)
        while loss(theta + step) > loss(theta) and np.abs(step).max() > 1e-12:
            step = step / 2
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / spread), float(theta[1] - theta[0] * middle / spread)


def training(labels: DataFrame, column: str, base: int, held: int) -> DataFrame:
    """doc_id and label (0 or 1) of the rows that may teach: their hashed id's remainder is not ``held``.

    Labels other than 0 and 1 are left out; an id with several labels takes the larger.
    """
    own = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    return own.where(remainder("doc_id", base) != held).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def flagged(rows: DataFrame, column: str, ids: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: true of every id in ``ids`` (one column, long) and of few others.

    A bitmap over hashed ids is broadcast: FILTER_SHARE bits an id, and never more than MOST_BITS. Columns of ``rows`` may
    have any name but ``flag``.
    """
    bits = 1 << min(MOST_BITS, max(16, (FILTER_SHARE * max(1, ids.count())).bit_length()))
    bit, word, mask = free(rows, "bit", "word", "mask")
    hashed = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    words = ids.select(hashed(ids.columns[0]).alias(bit)).groupBy(F.shiftright(bit, 6).alias(word))
    words = words.agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} % 64 as int)))").alias(mask))
    marked = rows.withColumn(bit, hashed(column)).withColumn(word, F.shiftright(bit, 6)).join(F.broadcast(words), word, "left")
    hit = F.expr(f"coalesce(shiftrightunsigned({mask}, cast({bit} % 64 as int)) & 1 = 1, false)") & F.col(column).isNotNull()
    return marked.select(*rows.columns, hit.alias(flag))


def among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids``, and few others."""
    (flag,) = free(rows, "flag")
    return flagged(rows, column, ids, flag).where(flag).drop(flag)


def labelled(docs: DataFrame, train: DataFrame) -> DataFrame:
    """text and the columns of ``train`` but doc_id, of the rows of ``docs`` that ``train`` names.

    Up to MOST_BROADCAST labels are broadcast; beyond that the bitmap spares most other texts the shuffle.
    """
    own = docs.select("doc_id", "text")
    if train.count() <= MOST_BROADCAST:
        return own.join(F.broadcast(train), "doc_id").drop("doc_id")
    return among(own, "doc_id", train.select("doc_id")).join(train, "doc_id").drop("doc_id")


def without(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows, all columns, whose id is not in ``ids`` (one column of distinct ids). Null ids stay.

    Up to MOST_BROADCAST ids are broadcast; beyond that only rows that the bitmap doubts are shuffled.
    """
    name, doubt = free(rows, "gone", "doubt")
    gone = ids.select(F.col(ids.columns[0]).alias(name))
    if ids.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(gone), F.col(column) == F.col(name), "left_anti")
    seen = flagged(rows, column, ids, doubt)
    rest = seen.where(doubt).join(gone, F.col(column) == F.col(name), "left_anti").select(rows.columns)
    return seen.where(~F.col(doubt)).select(rows.columns).unionByName(rest)


def sampled(docs: DataFrame, train: DataFrame, size: int) -> DataFrame:
    """text, label and the other columns of ``train`` of at most ``size`` training ids, those with the smallest hashes.

    Of rows that repeat an id, one teaches: that with the smallest hash of its text.
    """
    few = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    own = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    one = own.groupBy(train.columns).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return one.select("one.text", *[c for c in train.columns if c != "doc_id"])


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key, without ``size``, the key's number of rows) on ``key``.

    Rows of hot keys stay where they are: their part of the table, MOST_HOT keys at most, is broadcast. Only other rows are
    dealt by key. Both frames are read twice, so they should be stored ones.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) >= max(HOT, total // MOST_HOT + 1)
    common = table.where(hot).drop(size)
    if common.isEmpty():
        return rows.join(table.drop(size), key)
    rest = rows.join(F.broadcast(common.select(*key)), key, "left_anti").join(table.where(~hot).drop(size), key)
    return rows.join(F.broadcast(common), key).unionByName(rest)
