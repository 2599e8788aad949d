"""Near-duplicate documents by ProbMinHash signatures of weighted word shingles.

A shingle weighs ``1 + ln(count)``. Each register of a signature keeps the element whose
Poisson process (rate: the weight) arrives there first; an element stops once its next arrival
comes after every register of its text is filled earlier. Two signatures agree in a register
with the probability Jaccard of the two weighted sets. Banding proposes pairs and the exact
probability Jaccard, at SIMILARITY or more, confirms them.

Copies (the same words in the same order, whatever the case and white space) become one class
first, by grouped aggregation. In a bucket every class is compared with one hub, which is then done with; while verified links
leave a bucket in several parts, another hub of its largest part follows, and after HUB_ROUNDS
what is still apart is compared throughout. So a bucket of m near copies costs a few times m
comparisons, and every pair of classes that shares a bucket is either compared or already joined
by verified links. Texts that share a bucket are cut into shingles once; a hub's set travels once for PASSING texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, free, frugal, session, stored
from .components import components, forest
from .learn import among, spread_join, without
from .words import GOLDEN, U, WordCache, chunks, hash64, mix, shingles, token_hashes

WORDS = 5
SIMILARITY = 0.8
#: A pair at the threshold shares a bucket with probability 1 - (1 - 0.8**5)**22 = 0.9998.
BANDS, ROWS = 22, 5
#: Rounds in which a bucket is compared with one class of it, before what is left is compared throughout.
HUB_ROUNDS = 2
#: Texts that a hub's set is sent to at a time.
PASSING = 1_024
#: Rows that a task holds, and rows that pass by them, where a bucket is compared throughout.
BLOCK, LOAD = 512, 1_024


def words_of(text) -> list[str]:
    return text.lower().split() if text else []


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """ProbMinHash registers (n x size, element ids) of n weighted sets given as aligned arrays."""
    best = np.full(n * size, np.inf)
    kept = np.zeros(n * size, U)
    state = element.copy()
    time = np.zeros(len(doc))
    bound = np.full(n, np.inf)
    d, e, w = doc, element, weight
    while len(d):
        state = state + GOLDEN
        bits = mix(state)
        time = time - np.log1p(-((bits >> U(11)).astype(np.float64) * 2.0**-53)) / w
        slot = d * size + (mix(bits ^ U(0x5851F42D4C957F2D)) % U(size)).astype(np.int64)
        live = time < bound[d]
        d, e, w, state, time, slot = (x[live] for x in (d, e, w, state, time, slot))
        if not len(d):
            break
        np.minimum.at(best, slot, time)
        won = best[slot] == time
        kept[slot[won]] = e[won]
        here = np.unique(d)
        bound[here] = best.reshape(n, size)[here].max(axis=1)
    return kept.reshape(n, size)


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """sum_i 1 / sum_j max(x_j / x_i, y_j / y_i) over i where both weights are positive."""
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    ratio = np.full(len(x), np.inf)
    np.divide(x, y, out=ratio, where=y > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.concatenate([[0.0], np.cumsum(y)])  # ratio_j <= ratio_i: y_j / y_i is larger
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    i = np.flatnonzero((x > 0) & (y > 0))
    cut = np.searchsorted(ratio, ratio[i], side="right")
    return float(np.sum(1.0 / (above[cut] / x[i] + below[cut] / y[i])))


def _signed(lists: Iterator[list]) -> Iterator[tuple[list, dict]]:
    cache = WordCache(hash64)
    for texts in lists:
        for lo, hi in chunks(texts):
            cache.trim()
            flat, offsets = token_hashes([words_of(t) for t in texts[lo:hi]], cache)
            doc, h, count = shingles(flat, offsets, WORDS)
            sig = signatures(doc, h, 1.0 + np.log(count), hi - lo, BANDS * ROWS)
            band = np.zeros((hi - lo, BANDS), U)
            for r in range(ROWS):
                band = mix(band * GOLDEN + sig.reshape(hi - lo, BANDS, ROWS)[:, :, r])
            band = mix(band + np.arange(BANDS, dtype=U)).view(np.int64)
            rows = [(xxhash.xxh3_128_digest(flat[a:z].tobytes()), k) if z > a else (None, None) for a, z, k in zip(offsets[:-1], offsets[1:], band)]
            yield range(lo, hi), {"copy": [r[0] for r in rows], "bands": [r[1] for r in rows]}


@frugal
def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = WordCache(hash64)
    for b in batches:
        texts = b.text.tolist()
        for lo, hi in chunks(texts):
            cache.trim()
            flat, offsets = token_hashes([words_of(t) for t in texts[lo:hi]], cache)
            doc, h, count = shingles(flat, offsets, WORDS)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield pd.DataFrame({
                "id": b.id.iloc[lo:hi].to_numpy(),
                "elements": [h[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])],
                "counts": [count[a:z].astype(np.int32).tobytes() if z - a and count[a:z].max() > 1 else b"" for a, z in zip(cut[:-1], cut[1:])],
            })


@frugal
def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units come one after another, the hub's row (its y is null) before those that pass by it."""
    hub, ex, wx = None, None, None
    for b in batches:
        found = []
        for x, unit, own, y, e, c in zip(b.x, b.unit, b.hub, b.y, b.elements, b.counts):
            e = np.frombuffer(e, U)
            if own:
                hub, ex, wx = (x, unit), e, _weights(e, c)
            elif hub == (x, unit) and _similarity(ex, wx, e, _weights(e, c)) >= SIMILARITY:
                found.append((x, y))
        yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def _links(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs (x, y: ids of class representatives, x few and common) that the exact similarity confirms.

    A hub's rows are cut into units of about PASSING, so no hub is a hot key, and its set is sent once a unit.
    """
    pairs = stored(pairs, f"{name}_pairs")
    units = pairs.groupBy("x").agg(F.ceil(F.count("*") / PASSING).alias("units"))
    hubs = units.join(sets.withColumnRenamed("id", "x"), "x").withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)))
    unit = F.pmod(F.xxhash64("y", F.lit(7)), F.col("units"))
    come = pairs.join(F.broadcast(units.where("units > 1").toDF("x", "more")), "x", "left").withColumn("units", F.coalesce("more", F.lit(1).cast("long")))
    come = come.select("x", unit.alias("unit"), "y").join(sets.withColumnRenamed("id", "y"), "y")
    rows = hubs.select("x", "unit", F.lit(True).alias("hub"), F.col("x").alias("y"), "elements", "counts").unionByName(come.withColumn("hub", F.lit(False)))
    dealt = rows.repartition("x", "unit").sortWithinPartitions("x", "unit", F.col("hub").desc())
    return stored(dealt.mapInPandas(_verify, "u long, v long"), f"{name}_links")


def _shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, elements, counts) of the texts whose id is in ``ids``, and of few others."""
    own = among(docs.select(F.col("doc_id").alias("id"), "text").where("text is not null"), "id", ids)
    return stored(own.mapInPandas(_sets, "id long, elements binary, counts binary"), "sets")


def _parts(links: DataFrame) -> DataFrame:
    """(id, label): two steps towards the smallest linked id. Equal labels are connected; unequal ones may be, too."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = stored(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("m")), "near")
    sizes = near.groupBy("m").agg(F.count("*").alias("n"))
    return spread_join(near, stored(sizes.join(near.toDF("m", "label"), "m"), "steps"), ["m"], "n").select("id", "label")


def _unsettled(left: DataFrame, label: DataFrame) -> DataFrame:
    """(band, id, label) of the buckets that hold several labels."""
    left = stored(left.join(label, "id", "left").select("band", "id", F.coalesce("label", "id").alias("label")), "labelled")
    mixed = left.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    return spread_join(left, stored(mixed.select("band", "n"), "mixed"), ["band"], "n")


def _joined(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) links that connect all classes (band, id, hub in ``met``) which verified pairs connect."""
    rest = met.where("id > hub")
    links = _links(rest.select(F.col("hub").alias("x"), F.col("id").alias("y")).distinct(), sets, "hub0")
    left = rest.select("band", "id")
    for r in range(1, HUB_ROUNDS + 1):
        left = stored(_unsettled(left, _parts(links)), f"left{r}")
        parts = left.groupBy("band", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), "id")).alias("first"))
        hub = parts.groupBy("band").agg(F.max(F.struct("n", "label", "first.id")).alias("top"), F.sum("n").alias("size"))
        hub = stored(hub.select("band", F.col("top.id").alias("hub"), F.col("top.label").alias("part"), "size"), f"tops{r}")
        met_hub = stored(spread_join(left, hub, ["band"], "size"), f"hubs{r}")
        pairs = met_hub.where("label <> part").select(F.col("hub").alias("x"), F.col("id").alias("y")).distinct()
        more = _links(pairs, sets, f"hub{r}")
        links = links.unionByName(more)
        left = met_hub.where("id <> hub").select("band", "id")
        if more.isEmpty():
            break
    left = stored(_unsettled(left, stored(components(links), "labels")), "left")
    return links.unionByName(_rest(left, sets))


def _rest(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different labels within the buckets (band, id, label) of ``left``.

    Buckets with the same largest part are one group. Its other rows stay in blocks of BLOCK, and all its rows pass by
    them in loads of LOAD: no pair becomes a row, and no task holds more than a block.
    """
    parts = left.groupBy("band", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"))
    largest = stored(largest.select("band", F.col("top.label").alias("key"), "size"), "largest")
    rows = stored(spread_join(left, largest, ["band"], "size").select("key", "id", "label").distinct(), "groups")
    size = rows.groupBy("key").agg(F.ceil(F.count_if(F.col("label") != F.col("key")) / BLOCK).alias("blocks"), F.ceil(F.count("*") / LOAD).alias("loads"))
    h = lambda salt: F.abs(F.xxhash64("id", F.lit(salt)) % (1 << 30))
    every = rows.join(size, "key").join(sets, "id")
    stay = every.where("label <> key").withColumn("block", h(1) % F.col("blocks")).withColumn("load", F.explode(F.expr("sequence(0L, loads - 1)"))).withColumn("guest", F.lit(False))
    come = every.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("load", h(2) % F.col("loads")).withColumn("guest", F.lit(True))
    cols = ["key", "block", "load", "guest", "id", "label", "elements", "counts"]
    units = stay.select(cols).unionByName(come.select(cols)).repartition("key", "block", "load").sortWithinPartitions("key", "block", "load", "guest")
    return stored(units.mapInPandas(_compare, "u long, v long"), "rest_links")


def _weights(element: np.ndarray, counts: bytes) -> np.ndarray:
    return 1.0 + np.log(np.frombuffer(counts, np.int32)) if counts else np.ones(len(element))


def _similarity(ex: np.ndarray, wx: np.ndarray, ey: np.ndarray, wy: np.ndarray) -> float:
    every = np.union1d(ex, ey)
    vx, vy = np.zeros(len(every)), np.zeros(len(every))
    vx[np.searchsorted(every, ex)] = wx
    vy[np.searchsorted(every, ey)] = wy
    return probability_jaccard(vx, vy)


class _Residents:
    """A block of sets with an index from element to sets."""

    def __init__(self):
        self.ids, self.labels, self.sets, self.weights, self.plain = [], [], [], [], []
        self.ready = False

    def add(self, row) -> None:
        e = np.frombuffer(row.elements, U)
        self.ids.append(row.id)
        self.labels.append(row.label)
        self.sets.append(e)
        self.weights.append(_weights(e, row.counts))
        self.plain.append(not row.counts)
        self.ready = False

    def partners(self, row) -> list[int]:
        """Residents of another label whose similarity with the row reaches the threshold."""
        if not self.ready:
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            self.flat, self.owner = flat[order], np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])[order]
            self.size, self.label, self.simple = np.array([len(s) for s in self.sets]), np.array(self.labels), np.array(self.plain)
            self.ready = True
        e = np.frombuffer(row.elements, U)
        lo, hi = np.searchsorted(self.flat, e, "left"), np.searchsorted(self.flat, e, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sets))
        share = shared / (self.size + len(e) - shared)
        other = self.label != row.label
        if row.counts:
            sure, open_ = np.zeros(len(shared), bool), other & (shared > 0)
        else:
            sure, open_ = other & self.simple & (share >= SIMILARITY), other & ~self.simple & (shared > 0)
        found = [self.ids[i] for i in np.flatnonzero(sure)]
        w = _weights(e, row.counts)
        return found + [self.ids[i] for i in np.flatnonzero(open_) if _similarity(self.sets[i], self.weights[i], e, w) >= SIMILARITY]


@frugal
def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, block = None, _Residents()
    for b in batches:
        found = []
        for row in b.itertuples(index=False):
            k = (row.key, row.block, row.load)
            if k != key:
                key, block = k, _Residents()
            if not row.guest:
                block.add(row)
            elif block.ids:
                found += [(row.id, i) for i in block.partners(row)]
        links = forest(found)
        yield pd.DataFrame([(u, v) for u, v in links.items() if u != v], columns=["u", "v"], dtype="int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copies, kept for each distinct id of ``docs`` (doc_id, text; more may be there).

    class_id is the smallest id reachable by copies and verified links, ``copies`` the number of
    ids in the exact class, ``kept`` whether the row is its class's one. Null texts and texts
    without words hold no shingle: they link with nothing and stay. Texts of 1 to 4 words are one
    shingle. Rows that repeat an id count once, with the texts of all of them linking.
    Rows whose id is null are left out, as nothing can name them.
    """
    session(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = _classes(docs).select("doc_id", "class_id", "copies")
    else:
        out = _tied(docs)
    return out.select("*", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def _tied(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies) where ids repeat: rows are compared by a number of their own, ids tie them at the end."""
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = _classes(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "rep", F.col("class_id").alias("group"))
    rows = stored(rows.select("row", "doc_id").join(found, "row"), "grouped")
    low = rows.groupBy("group").agg(F.min("doc_id").alias("v"))
    label = stored(components(rows.join(low, "group").select(F.col("doc_id").alias("u"), "v").distinct()), "tied")
    size = rows.select("rep", "doc_id").distinct().groupBy("rep").agg(F.count("*").alias("copies"))
    one = rows.join(size, "rep").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    one = one.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return one.select("doc_id", F.coalesce("label", "doc_id").alias("class_id"), "copies")


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, rep, class_id, copies) of rows whose doc_id is their own; rep is the smallest one of the exact class."""
    signed = stored(beside(docs, _signed, "copy binary, bands array<long>"), "signed")
    worded = signed.where("copy is not null")
    classes = stored(worded.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    own = worded.join(classes.select("copy", F.col("rep").alias("doc_id")), ["copy", "doc_id"], "left_semi")
    bands = stored(own.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band")), "bands")
    shared = bands.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("hi"), F.count("*").alias("n")).where("hub < hi")
    met = stored(spread_join(bands, stored(shared.select("band", "hub", "n"), "shared"), ["band"], "n"), "met")
    links = _joined(met, _shingle_sets(docs, met.select("id").distinct()))

    same = stored(worded.select("doc_id", "copy").join(classes, "copy").select("doc_id", "rep", "copies"), "members")
    whole = stored(components(links), "final").select(F.col("id").alias("rep"), "label")
    out = same.join(whole, "rep", "left").select("doc_id", "rep", F.coalesce("label", "rep").alias("class_id"), "copies")
    blank = signed.where("copy is null").select("doc_id", F.col("doc_id").alias("rep"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    return out.unionByName(blank)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, one of each class and one of each id; all columns stay.

    Of rows that repeat an id, one stays (any: their ids tell them no further). Rows with a null id stay, and so do null
    texts and texts without words, one row an id.
    """
    gone = stored(near_duplicates(docs).where("not kept").select("doc_id"), "gone")
    own = without(docs, "doc_id", gone)
    twice = stored(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "twice")
    if not twice.isEmpty():
        (name,) = free(own, "twice")
        again = own.join(twice.withColumnRenamed("doc_id", name), F.col("doc_id") == F.col(name), "left_semi")
        own = without(own, "doc_id", twice).unionByName(again.dropDuplicates(["doc_id"]))
    return own
