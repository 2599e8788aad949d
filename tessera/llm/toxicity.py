"""Toxic passages as maximal-scoring segments of token log-odds.

A token's score is its log-odds between toxic and other training texts under an informative
Dirichlet prior (the corpus' own shares), drawn towards zero by its standard error, minus a drift
that makes the expected score negative. A linear scan finds every maximal segment of a text. The
extreme-value law of segment scores turns a score S in a text of n tokens into
``rate * S - ln(scale * n)``; what is above ``-ln(EXPECTED)`` is a significant passage. The sum of
its significant passages, or else its best segment, scores a text.

Calibration is cross-fitted: the segments of a teaching row are found with token scores learnt from
the other FOLDS - 1 folds of teaching rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, frugal, remainder, session, tidy
from .learn import labelled, logistic, sampled, training
from .words import U, WordCache, chunks, hash64, token_hashes

TOKENS = 1 << 18
#: Rows that calibration uses at most; token counts come from all training rows.
SAMPLE = 8_000
FOLDS = 5
#: Texts scored beyond this expectation are no significant passages.
EXPECTED = 0.05


class Settings(NamedTuple):
    """Weight of the corpus' shares as a prior, standard errors by which log-odds are drawn to zero, and the drift.

    The defaults had the least ``cross_validated`` loss among 27 settings over the teaching rows of a 10,000-document table.
    """

    prior: float = 0.03
    deviations: float = 1.0
    drift: float = 2.0


EULER = 0.5772156649015329


def token(word: str) -> int:
    return hash64(word.lower().strip(".,;:!?()[]{}\"'«»“”…-*#$%&|") or word) % TOKENS


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time.

    Only runs of positive scores are visited; cumulative sums carry what lies between.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]]).astype(np.int8)))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, nearest lower
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        low, high = float(total[start]), float(total[end])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                stack.append((low, high, start, end, j))
                break
            low, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, hi - lo) for lo, hi, s, e, _ in stack]


def _tokens(texts: list, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    cache.trim()
    flat, offsets = token_hashes([t.split() if t else [] for t in texts], cache)
    return flat.astype(np.int64), offsets


@frugal
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens by fold and label: class 2 * fold + label."""
    cache, total = WordCache(token), np.zeros((2 * FOLDS, TOKENS), np.int64)
    for b in batches:
        texts, y = b.text.tolist(), 2 * b.fold.to_numpy() + b.label.to_numpy()
        for lo, hi in chunks(texts):
            flat, offsets = _tokens(texts[lo:hi], cache)
            at = np.repeat(y[lo:hi], np.diff(offsets)).astype(np.int64) * TOKENS + flat
            total += np.bincount(at, minlength=total.size).reshape(total.shape)
    t = np.flatnonzero(total.any(axis=0))
    yield pd.DataFrame({"token": t, **{f"n{part}": total[part, t] for part in range(len(total))}})


def _found(texts: list, cache: WordCache, scores: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """For each text its token count and its maximal segments."""
    for lo, hi in chunks(texts):
        flat, offsets = _tokens(texts[lo:hi], cache)
        s = scores[flat]
        for a, z in zip(offsets[:-1], offsets[1:]):
            yield int(z - a), segments(s[a:z])


@frugal
def _best(batches: Iterator[pd.DataFrame], scores) -> Iterator[pd.DataFrame]:
    """Segment scores of labelled texts, each by the scores that its own fold did not teach."""
    cache = WordCache(token)
    for b in batches:
        for fold, own in b.groupby("fold"):
            rows = [(n, [x[2] for x in found]) for n, found in _found(own.text.tolist(), cache, scores[fold])]
            yield pd.DataFrame({"label": own.label.to_numpy(), "fold": fold, "n": [r[0] for r in rows], "sums": [r[1] for r in rows]})


def evidence(n: int, sums: list[float], rate: float, scale: float) -> float:
    """Calibrated evidence of a text; 0 means one such segment is expected by chance."""
    if not n or not len(sums):
        return float(-np.log(scale * max(n, 1)))
    level = rate * np.asarray(sums, float) - np.log(scale * n)
    return float(max(level.max(), level[level > -np.log(EXPECTED)].sum()))


def log_odds(clean: np.ndarray, toxic: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """Scores per token, without drift."""
    both = clean + toxic
    prior = settings.prior * both
    n1, n0, a0 = toxic.sum(), clean.sum(), prior.sum()
    x, y = toxic + prior, clean + prior
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.log(x / (n1 + a0 - x)) - np.log(y / (n0 + a0 - y))
        error = np.sqrt(1 / x + 1 / y)
        out = np.sign(delta) * np.maximum(0, np.abs(delta) - settings.deviations * error)
    return np.where(both > 0, np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0), 0.0)


def token_scores(clean: np.ndarray, toxic: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Scores with drift, and the rate of their extreme values in clean text."""
    scores = log_odds(clean, toxic, settings) - settings.drift
    null = clean + settings.prior * (clean + toxic)
    return scores, karlin_rate(scores, null / max(1.0, null.sum()))


def karlin_rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share * exp(rate * score) = 1."""
    lo, hi = 1e-6, 1.0
    excess = lambda r: float(np.sum(share * np.exp(np.minimum(r * scores, 500)))) - 1
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _folded(labels: DataFrame, column: str, base: int, held: int) -> DataFrame:
    return training(labels, column, base, held).withColumn("fold", F.pmod(F.xxhash64(F.lit(FOLDS), "doc_id"), F.lit(FOLDS)).cast("int"))


def token_counts(docs: DataFrame, train: DataFrame) -> np.ndarray:
    """FOLDS x (clean, toxic) x TOKENS counts over all teaching rows: a table of a fixed size."""
    names = [f"n{part}" for part in range(2 * FOLDS)]
    counts = labelled(docs, train).mapInPandas(_count, "token long, " + ", ".join(f"{n} long" for n in names))
    counts = counts.groupBy("token").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    total = np.zeros((2 * FOLDS, TOKENS), np.int64)
    total[:, counts.token] = counts[names].to_numpy().T
    del counts
    tidy()
    return total.reshape(FOLDS, 2, TOKENS)


def _calibration(rows: pd.DataFrame, rates: list[float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Evidence and labels of cross-fitted rows, and the scale of extreme values."""
    y, n = rows.label.to_numpy(float), rows.n.to_numpy()
    rate = np.asarray(rates)[rows.fold.to_numpy()]
    top = np.array([max(s, default=0.0) for s in rows.sums])
    calm = (y == 0) & (n > 0)
    scale = float(np.exp(np.mean(rate[calm] * top[calm] - np.log(n[calm])) - EULER)) if calm.any() else 1.0
    x = np.array([evidence(m, s, r, scale) for m, s, r in zip(n, rows.sums, rate)])
    return np.clip(x, -50, 50), y, scale


def _cross_fitted(docs: DataFrame, train: DataFrame, counts: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    every = counts.sum(axis=0)
    scores, rates = np.empty((FOLDS, TOKENS), np.float32), []
    for fold, own in enumerate(counts):
        scores[fold], rate = token_scores(*(every - own).astype(float), settings)
        rates.append(rate)
    rows = sampled(docs, train, SAMPLE).mapInPandas(partial(_best, scores=scores), "label int, fold int, n long, sums array<double>").toPandas()
    del scores
    tidy()
    return _calibration(rows, rates)


def cross_validated(docs: DataFrame, labels: DataFrame, choices: list[Settings], column: str = "toxic", base: int = 5, held: int = 0) -> dict[Settings, float]:
    """The mean log loss of each of ``choices`` over teaching rows alone, scored by what other folds taught; smaller is better."""
    session(docs.sparkSession)
    train = _folded(labels, column, base, held)
    counts, out = token_counts(docs, train), {}
    for settings in choices:
        x, y, _ = _cross_fitted(docs, train, counts, settings)
        slope, level = logistic(x, y)
        out[settings] = float(np.mean(np.logaddexp(0, -np.where(y > 0.5, 1, -1) * (slope * x + level))))
    return out


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", base: int = 5, held: int = 0, settings: Settings = Settings()) -> tuple:
    """(token scores, rate, scale, slope, level). Without rows of both labels, all texts get the smoothed share of ones."""
    session(docs.sparkSession)
    train = _folded(labels, column, base, held)
    counts = token_counts(docs, train)
    scores, rate = token_scores(*counts.sum(axis=0).astype(float), settings)
    x, y, scale = _cross_fitted(docs, train, counts, settings)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return scores, rate, 1.0, 0.0, float(np.log(share / (1 - share)))
    return scores, rate, scale, *logistic(x, y)


def judged(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, score (0 to 1) and significant passages (token range, score, expected number by chance) per row.

    Null and empty texts have no segment: they get the least evidence and no passage. Ids, null ones too, come back as they
    are; repeated rows have a score each.
    """
    session(docs.sparkSession)
    scores, rate, scale, slope, level = model

    def judge(n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[dict]]:
        x = slope * evidence(n, [f[2] for f in found], rate, scale) + level
        sure = [f for f in found if rate * f[2] - np.log(scale * n) > -np.log(EXPECTED)]
        passages = [{"start": s, "end": e, "score": v, "expected": float(scale * n * np.exp(-rate * v))} for s, e, v in sure]
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, x))))), passages

    def work(lists):
        cache = WordCache(token)
        for texts in lists:
            rows = [judge(n, found) for n, found in _found(texts, cache, scores)]
            yield range(len(rows)), {"score": [r[0] for r in rows], "passages": [r[1] for r in rows]}

    return beside(docs.select("doc_id", "text"), work, "score double, passages array<struct<start:int,end:int,score:double,expected:double>>")


def scored(docs: DataFrame, model: tuple, base: int, held: int) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages."""
    return judged(docs, model).select(
        "doc_id", (remainder("doc_id", base) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )
