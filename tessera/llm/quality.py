"""Quality classifier: a linear SVM over n-gram indicators scaled by naive Bayes log-count ratios.

Indicators: word 1- and 2-grams, and 1- to 3-grams of token shapes (runs of character classes; a
token equal to the one before has a shape of its own), hashed into FEATURES buckets. The ratios
come from all labelled training rows, by grouped aggregation; the hinge loss is fitted by dual
coordinate descent, until the duality gap closes, on SAMPLE rows at most, those with the smallest
hashed ids; margins become probabilities by a logistic fit on rows held out of a first fit.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, frugal, remainder, session, tidy
from .learn import labelled, logistic, sampled, training
from .words import GOLDEN, U, WordCache, chunks, hash64, mix, token_hashes

FEATURES = 1 << 18
#: Bound of the rows that the SVM is fitted on. The counts behind the ratios have no bound.
SAMPLE = 8_000
SMOOTHING, COST, PULL = 1.0, 1.0, 0.25
#: Descent ends at a duality gap of this share of the loss; a fit that needs more epochs warns.
GAP, MOST_EPOCHS = 0.01, 300

_CLASSES = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1"))


def shape(word: str) -> str:
    """'Xx' for Word, 'X' for WORD, 'x' for word, '0' for digits; runs of one mark become one."""
    letters = lambda m: "x" if m[0].islower() else "X" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0].istitle() else "xX"
    for pattern, to in _CLASSES:
        word = pattern.sub(letters if to is None else to, word)
    return word


def indicators(texts: list, words: WordCache, shapes: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, feature) pairs, ordered."""
    words.trim()
    shapes.trim()
    tokens = [t.split() if t else [] for t in texts]
    flat, offsets = token_hashes(tokens, words)
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    form, _ = token_hashes(tokens, shapes)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    same = np.zeros(len(flat), bool)
    same[1:] = (flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])
    form = np.where(same, U(1), form)
    keys = []
    for salt, stream, n in ((1, flat, 2), (2, form, 3)):
        h = stream * GOLDEN + U(salt)
        for k in range(n):
            if k:
                h = mix(h[:-1]) * GOLDEN + stream[k:]
            at = doc[k:]
            inside = at == doc[: len(at)]
            keys.append((at * FEATURES + (mix(h) % U(FEATURES)).astype(np.int64))[inside])
    key = np.unique(np.concatenate(keys))
    return key // FEATURES, key % FEATURES


@frugal
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words, shapes = WordCache(hash64), WordCache(lambda w: hash64(shape(w)))
    total = np.zeros((2, FEATURES), np.int64)
    for b in batches:
        texts, y = b.text.tolist(), b.label.to_numpy()
        for lo, hi in chunks(texts):
            doc, f = indicators(texts[lo:hi], words, shapes)
            for label in (0, 1):
                total[label] += np.bincount(f[y[lo:hi][doc] == label], minlength=FEATURES)
    f = np.flatnonzero(total.any(axis=0))
    yield pd.DataFrame({"feature": f, "bad": total[0, f], "good": total[1, f]})


@frugal
def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words, shapes = WordCache(hash64), WordCache(lambda w: hash64(shape(w)))
    for b in batches:
        texts = b.text.tolist()
        for lo, hi in chunks(texts):
            doc, f = indicators(texts[lo:hi], words, shapes)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield pd.DataFrame({"label": b.label.iloc[lo:hi].to_numpy(), "features": [f[a:z].astype(np.uint32).tobytes() for a, z in zip(cut[:-1], cut[1:])]})


def _scores(texts: list, words: WordCache, shapes: WordCache, model) -> np.ndarray:
    ratio, weight, slope, level = model
    squared, weighted = ratio * ratio, ratio * weight
    out = []
    for lo, hi in chunks(texts):
        doc, f = indicators(texts[lo:hi], words, shapes)
        size = np.bincount(doc, squared[f], hi - lo)
        dot = np.bincount(doc, weighted[f], hi - lo)
        out.append(dot / np.sqrt(np.maximum(size, 1e-12)))
    margin = np.concatenate(out) if out else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(slope * margin + level, -30, 30)))


class Problem:
    """The hinge-loss SVM 1/2 |w|^2 + COST * sum max(0, 1 - y w x) over unit-length rows of scaled indicators."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray):
        self.rows, self.y = rows, np.asarray(y, float)
        self.values = [(ratio[f] / max(1e-6, float(np.sqrt(np.sum(ratio[f] ** 2))))).astype(np.float32) for f in rows]
        self.squares = np.array([float(v @ v) for v in self.values])

    def losses(self, w: np.ndarray, alpha: np.ndarray) -> tuple[float, float]:
        """The primal loss of ``w`` and the dual value of ``alpha``; they meet at the optimum."""
        margin = self.y * np.array([float(w[f] @ v) for f, v in zip(self.rows, self.values)])
        half = float(w @ w) / 2
        return half + COST * float(np.maximum(0, 1 - margin).sum()), float(alpha.sum()) - half

    def solved(self, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
        """Weights and dual variables by dual coordinate descent in random order."""
        w, rng = np.zeros(FEATURES), np.random.default_rng(seed)
        alpha = np.where(self.squares == 0, COST, 0.0)  # rows without a feature lose 1 whatever the weights
        for _ in range(MOST_EPOCHS):
            for i in rng.permutation(len(self.rows)):
                if self.squares[i] == 0:
                    continue
                f, v, y = self.rows[i], self.values[i], self.y[i]
                gradient = y * float(w[f] @ v) - 1
                new = min(COST, max(0.0, alpha[i] - gradient / self.squares[i]))
                if new != alpha[i]:
                    w[f] += (new - alpha[i]) * y * v
                    alpha[i] = new
            primal, dual = self.losses(w, alpha)
            if primal - dual <= GAP * primal:
                return w, alpha
        warnings.warn(f"dual coordinate descent stopped at a gap of {(primal - dual) / primal:.3f}", stacklevel=2)
        return w, alpha


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Weights of the SVM, drawn in part towards their mean size: some of the weight is the ratio's own."""
    w, _ = Problem(rows, y, ratio).solved()
    seen = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.int64)
    level = np.abs(w[seen]).mean() if len(seen) else 0.0
    return (1 - PULL) * w + PULL * level * (w != 0)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", base: int = 3, held: int = 1) -> tuple:
    """(ratio, weight, slope, level). Without rows of both labels, every score is the smoothed share of ones."""
    session(docs.sparkSession)
    train = training(labels, column, base, held)
    counts = labelled(docs, train).mapInPandas(_count, "feature long, bad long, good long")
    counts = counts.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    p, q = np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)
    p[counts.feature] += counts.good
    q[counts.feature] += counts.bad
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[np.setdiff1d(np.arange(FEATURES), counts.feature)] = 0.0
    rows = sampled(docs, train, SAMPLE).mapInPandas(_features, "label int, features binary").toPandas()
    y = rows.label.to_numpy(float)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return ratio, np.zeros(FEATURES), 0.0, float(np.log(share / (1 - share)))
    order = np.argsort([hash64(bytes(b).hex()) for b in rows.features], kind="stable")
    lists = [np.frombuffer(rows.features[i], np.uint32) for i in order]
    y = y[order]
    third = max(1, len(y) // 3)
    margin = lambda w, fs: np.array([float(w[f] @ ratio[f]) / max(1e-6, float(np.sqrt(np.sum(ratio[f] ** 2)))) for f in fs])
    slope, level = 4.0, 0.0
    if len(np.unique(y[:third])) == 2 and len(np.unique(y[third:])) == 2:
        first = descend(lists[third:], 2 * y[third:] - 1, ratio)
        slope, level = logistic(margin(first, lists[:third]), y[:third])
    weight = descend(lists, 2 * y - 1, ratio)
    del rows, lists
    tidy()
    return ratio, weight, slope, level


def scored(docs: DataFrame, model: tuple) -> DataFrame:
    """``docs``' rows as doc_id and score (0 to 1, higher: label 1 likelier), one per row; null and empty texts too.

    Ids, null ones too, come back as they are; repeated rows have a score each.
    """
    session(docs.sparkSession)

    def work(lists):
        words, shapes = WordCache(hash64), WordCache(lambda w: hash64(shape(w)))
        for texts in lists:
            yield range(len(texts)), {"score": _scores(texts, words, shapes, model)}

    return beside(docs.select("doc_id", "text"), work, "score double")


def accepted(docs: DataFrame, model: tuple, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is at least ``least``.

    Null texts are scored as empty ones; rows of null or repeated ids are judged by their own texts.
    """
    session(docs.sparkSession)

    @frugal
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = WordCache(hash64), WordCache(lambda w: hash64(shape(w)))
        for b in batches:
            yield b.filter(pa.array(_scores(b.column("text").to_pylist(), words, shapes, model) >= least))

    return docs.mapInArrow(keep, docs.schema)


def judged(docs: DataFrame, model: tuple, base: int, held: int) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    s = scored(docs, model)
    return s.select("doc_id", (remainder("doc_id", base) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
