"""A probabilistic suffix tree over words: contexts of variable length, smoothed next words, scores by longest suffix.

The root predicts a token from its count alone. A context of up to DEPTH words before a token (a text's beginning is one of
its words) is a candidate when it occurs CONTEXT times. With N occurrences, T different tokens behind it and a count c,

    P(token | context) = (c - 1) / N + T / N * P(token | the context without its first word)

which adds up to one. A context is retained if its shorter suffix is, and if its predictions diverge from that suffix: the
log likelihood that it adds over its occurrences must pay COST for each token that it predicts itself. Tokens seen once
behind a context are left to the suffix by the formula, so only their number is kept.

The log probability of a token behind its longest retained suffix is a sum: its root value, for every retained suffix of
what stands before it log10(T / N), and, where the token was seen at least twice behind that suffix, the gain over this.
So a model is a table of keys and addends. Its commonest rows are broadcast; the rest is joined with the texts' keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, free, frugal, remainder, session, stored, tidy
from .words import GOLDEN, U, chunks, mix

#: Words of a context at most, occurrences it needs, and natural log units that each of its own predictions must earn.
DEPTH, CONTEXT, COST = 2, 64, 2.0
#: Rows of a model that are broadcast at most, the commonest ones, after a count: 12 bytes each, so 200 MB a worker.
MOST_BROADCAST = 16_000_000
#: They pass through the driver and are broadcast in pieces, by so many first bits of their keys.
PIECE_BITS = 3
#: Contexts (a few numbers each) that are broadcast at most while a tree is fitted, after a count.
MOST_STATES = 500_000
#: Sequences that a task counts before it passes them on, and bits (as a power of two) of the filter over contexts.
HELD, BITS = 2_000_000, 27
#: A context that has one token in HOT (and LEAST_HOT at least) before it is dealt in SALTS parts, by what follows it.
HOT, LEAST_HOT, SALTS = 2_000, 4_096, 64
#: Bytes of a word that are hashed block by block; longer ones are hashed one by one.
BLOCKS = 64
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Columns that carry the keys of a text to the rare part of a model.
KINDS, KEYS, TIMES = "_kinds", "_keys", "_times"
#: Texts begin behind START and end with END: no word has a blank.
START, END, STATE = (xxhash.xxh3_64_intdigest(x) for x in (b" start", b" end", b" state"))


class Model(NamedTuple):
    words: DataFrame  # key, n
    extra: DataFrame  # key, value, n
    tokens: int
    distinct: int
    depth: int


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def joined(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The key of a sequence from those of the sequence without its last and without its first word: Spark's xxhash64(before, after)."""
    # Fixed values of xxHash64.
    p1, p2, p3, p4, p5 = map(U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: x << U(n) | x >> U(64 - n)
    h = np.full(len(before), 42, U)
    for word in (before, after):
        h = turned((h + p5 + U(8)) ^ turned(word * p2, 31) * p1, 27) * p1 + p4
        h = (h ^ h >> U(33)) * p2
        h = (h ^ h >> U(29)) * p3
        h = h ^ h >> U(32)
    return h


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, A-Z lower-cased, and the text it is in."""
    raw = b"\n".join([t or b"" for t in texts])
    low = LOWER[np.frombuffer(raw + b" " * 8, np.uint8)]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~BLANK[low[: len(raw)]]
    edge = np.flatnonzero(np.diff(inside))
    start, size = edge[::2], edge[1::2] - edge[::2]
    begins = np.cumsum([0, *[len(t or b"") + 1 for t in texts]])
    owner = np.searchsorted(begins, start, side="right") - 1
    h = mix(size.astype(U) + GOLDEN)
    eight = np.lib.stride_tricks.as_strided(low[:8].view("<u8"), (len(low) - 7,), (1,)) if len(low) >= 8 else np.empty(0, U)
    live, at = np.flatnonzero(size <= BLOCKS), 0
    while len(live):
        left = size[live] - at
        block = eight[start[live] + at] & np.where(left >= 8, U(2**64 - 1), (U(1) << (U(8) * np.minimum(left, 7).astype(U))) - U(1))
        h[live] = mix(h[live] * GOLDEN ^ block)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > BLOCKS).tolist():
        h[i] = xxhash.xxh3_64_intdigest(low[start[i] : start[i] + size[i]].tobytes())
    return h, owner


def _sequences(texts: list[bytes | None], depth: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of the sequences of 1 to depth + 1 words that end at each token, the token's place in its text, and its text.

    Place 0 is START. A key of k words is meaningful from place k - 1 on.
    """
    flat, owner = word_hashes(texts)
    sizes = np.bincount(owner, minlength=len(texts)) + 2
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(text)) - np.repeat(ends - sizes, sizes)
    words = np.empty(len(text), U)
    words[ends - sizes], words[ends - 1], words[np.arange(len(flat)) + 2 * owner + 1] = U(START), U(END), flat
    keys = [words]
    for _ in range(depth):
        last = keys[-1]
        keys.append(np.concatenate([last[:1], joined(last[:-1], last[1:])]))
    return keys, place, text


@frugal
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted(batches, 0, None, None)


def _counted(batches: Iterator[pa.RecordBatch], depth: int, bits: np.ndarray | None, hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(before, salt, after, n) of the sequences of depth + 1 words whose context is in ``bits``, added up; single words are ``after``.

    Rows come out sorted by context, so that they take little room on their way.
    """
    held, size = [], 0

    def passed() -> Iterator[pa.RecordBatch]:
        whole, before, after, n = (np.concatenate(c) for c in zip(*held))
        held.clear()
        _, first, where = np.unique(whole, return_index=True, return_inverse=True)
        n, before, after = np.bincount(where, n).astype(np.int64), before[first], after[first]
        order = np.argsort(before)
        n, before, after = n[order], before[order], after[order]
        salt = np.where(np.isin(before, hot), after % U(SALTS), U(0)).astype(np.int32) if depth else np.zeros(len(n), np.int32)
        for lo in range(0, len(n), 20_000):
            part = slice(lo, lo + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(before[part])), pa.array(salt[part]), pa.array(_signed(after[part])), pa.array(n[part])], names=["before", "salt", "after", "n"])

    for b in batches:
        texts = b.column(0).to_pylist()
        for lo, hi in chunks(texts):
            keys, place, _ = _sequences(texts[lo:hi], depth)
            at = np.flatnonzero(place >= max(1, depth))
            if depth:
                at = at[_marked(bits, keys[depth - 1][at - 1])]
            whole, first, n = np.unique(keys[depth][at], return_index=True, return_counts=True)
            at = at[first]
            after = keys[depth - 1][at] if depth else whole
            held.append((whole, keys[depth - 1][at - 1] if depth else after, after, n))
            size += len(at)
            if size > HELD:
                yield from passed()
                size = 0
    if size:
        yield from passed()


def _places(bits: int) -> tuple[int, ...]:
    """By how much a key is shifted for its two places in a filter."""
    return 0, 64 - (bits - 1).bit_length()


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    size, out = len(bits) * 64, True
    for shift in _places(size):
        at = keys >> U(shift) & U(size - 1)
        out = out & (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)
    return out


def _filter(keys: DataFrame) -> np.ndarray:
    """A bitmap over the keys of a one-column frame, two bits a key, that lets few others through.

    It has 2 ** BITS bits at most; of more keys than an eighth of those it would let most others through, so it lets all.
    Tasks send packed places to the driver, a part at a time.
    """
    n = keys.count()
    if n > 1 << (BITS - 3):
        return np.full(1, 2**64 - 1, U)
    bits = 1 << min(BITS, max(12, (16 * max(1, n)).bit_length()))
    shifts = _places(bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).view(U)
            at = np.concatenate([own >> U(shift) & U(bits - 1) for shift in shifts]).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary())], names=["places"])

    out = np.zeros(bits // 64, U)
    for row in keys.mapInArrow(pack, "places binary").toLocalIterator():
        at = np.frombuffer(row.places, np.uint32)
        np.bitwise_or.at(out, at >> 6, U(1) << (at & np.uint32(63)).astype(U))
    return out


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, a stored frame, to be broadcast if a count finds MOST_STATES at most."""
    return F.broadcast(rows) if rows.count() <= MOST_STATES else rows


def teaching(docs: DataFrame, base: int, held: int) -> DataFrame:
    """Texts that may teach: the remainder of their hashed id is not ``held``. Rows without an id teach."""
    return docs.where(F.coalesce(remainder("doc_id", base) != held, F.lit(True))).select(F.col("text").cast("binary").alias("text"))


def fit(texts: DataFrame, depth: int = DEPTH, context: int = CONTEXT, cost: float = COST) -> Model:
    """The tree of ``texts`` (one column, binary). Without texts the root knows nothing and there is no context."""
    spark = session(texts.sparkSession)
    schema = "before long, salt int, after long, n long"
    words = texts.mapInArrow(_count_words, schema).groupBy(F.col("after").alias("key")).agg(F.sum("n").alias("n"))
    words = stored(words, "words")
    distinct, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = F.lit(tokens + 0.5 * (distinct + 1))
    known = words.select("key", ((F.col("n") + 0.5) / shared).alias("p"))
    extra = []
    start, end, state_ = (int(np.array([x], U).view(np.int64)[0]) for x in (START, END, STATE))
    # every text has one START and one END
    candidates = words.where(F.col("n") >= context).select(F.when(F.col("key") == end, start).otherwise(F.col("key")).alias("context"), "n")
    suffixes = None
    for level in range(1, depth + 1):
        bits = spark.sparkContext.broadcast(_filter(candidates.select("context")))
        hot = candidates.where(F.col("n") >= max(LEAST_HOT, tokens // HOT)).select("context").toArrow()["context"].to_numpy().view(U)  # HOT at most

        @frugal
        def count(batches, level=level, bits=bits, hot=hot):
            yield from _counted(batches, level, bits.value, hot)

        # Dealt once, by context and salt. Tokens seen once behind a context are then added up: only their number counts.
        pairs = texts.mapInArrow(count, schema).repartition("before", "salt").groupBy("before", "salt", "after").agg(F.sum("n").alias("n"))
        own = pairs.groupBy("before", "salt", F.when(F.col("n") > 1, F.col("after")).alias("after")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).drop("salt")
        own = stored(own, f"level{level}")
        states = own.groupBy("before").agg(F.sum("n").alias("total"), (F.sum("kinds") / F.sum("n")).alias("left"), F.sum(F.when(F.col("after").isNull(), F.col("n")).otherwise(0)).alias("once"))
        states = states.where(F.col("total") >= context)
        if suffixes is not None:
            states = states.join(suffixes, "before", "left_semi")
        states = stored(states, f"candidates{level}")
        parent = known.select(F.col("key").alias("after"), F.col("p").alias("q"))
        seen = own.where(F.col("after").isNotNull()).select("before", "after", "n").join(parent, "after").join(_small(states), "before")
        seen = stored(seen.withColumn("p", (F.col("n") - 1) / F.col("total") + F.col("left") * F.col("q")), f"predictions{level}")
        judged = seen.groupBy("before").agg(F.sum(F.col("n") * F.log(F.col("p") / F.col("q"))).alias("gain"), F.count("*").alias("own"), F.first("once").alias("once"), F.first("left").alias("left"), F.first("total").alias("n"))
        retained = stored(judged.where(F.col("gain") + F.col("once") * F.log("left") >= cost * (F.col("own") + 1)).select("before", "left", "n"), f"states{level}")
        kept = seen.join(_small(retained.select("before")), "before").withColumn("key", F.xxhash64("before", "after"))
        state = F.xxhash64("before", F.lit(state_))
        extra += [retained.select(state.alias("key"), F.log10("left").cast("float").alias("value"), "n"), kept.select("key", F.log10(F.col("p") / (F.col("left") * F.col("q"))).cast("float").alias("value"), "n")]
        if level < depth:
            known = kept.select("key", "p")
            # A longer context is a frequent sequence whose shorter suffix is retained.
            longer = seen.where(F.col("n") >= context).select(F.xxhash64("before", "after").alias("context"), F.col("after").alias("suffix"), "n")
            own_suffix = retained.select(F.col("before").alias("suffix"))
            candidates = stored(longer.join(own_suffix, "suffix", "left_semi").select("context", "n"), f"contexts{level}")
            suffixes = candidates.select(F.col("context").alias("before"))
    rows = extra[0]
    for more in extra[1:]:
        rows = rows.unionByName(more)
    return Model(words, stored(rows, "model"), tokens, distinct, depth)


class Table:
    """Sorted keys with their values, looked up many at a time: a key's leading bits, but the first ``skip``, say where its bucket begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, skip: int = 0):
        self.keys, self.values, self.skip = keys, values, U(skip)
        self.shift = U(64 - max(1, len(keys).bit_length()))
        sizes = np.bincount(self._bucket(keys), minlength=1 << (64 - int(self.shift)))
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32 if len(keys) < 2**31 else np.int64)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys << self.skip >> self.shift).astype(np.int64)

    def found(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, 0 where there is none."""
        out = np.zeros(len(keys), self.values.dtype)
        bucket = self._bucket(keys)
        at, end = self.start[bucket], self.start[bucket + 1]
        live = np.flatnonzero(at < end)
        at, end, wanted = at[live], end[live], keys[live]
        while len(live):
            there = self.keys[at]
            hit = there == wanted
            out[live[hit]] = self.values[at[hit]]
            at = at + 1
            on = (there < wanted) & (at < end)
            live, at, end, wanted = live[on], at[on], end[on], wanted[on]
        return out


class Pieces:
    """A table in 2 ** PIECE_BITS pieces by the keys' first bits."""

    def __init__(self, tables: list[Table]):
        self.tables = tables

    def found(self, keys: np.ndarray) -> np.ndarray:
        out, piece = np.zeros(len(keys)), keys >> U(64 - PIECE_BITS)
        for i, t in enumerate(self.tables):
            at = np.flatnonzero(piece == U(i))
            out[at] = t.found(keys[at])
        return out


def _pieces(rows: DataFrame, value: str) -> list:
    """The rows' sorted keys and values as broadcasts; the driver holds one piece at a time."""
    out = []
    for i in range(1 << PIECE_BITS):
        t = rows.where(F.shiftrightunsigned("key", 64 - PIECE_BITS) == i).select("key", value).toArrow()
        values, keys = t[value].to_numpy(), t["key"].to_numpy().view(U)
        del t
        if value == "n" and len(values):
            values = values.astype(np.min_scalar_type(int(values.max())))
        order = np.argsort(keys)
        out.append(rows.sparkSession.sparkContext.broadcast((keys[order], values[order])))
        del keys, values, order
        tidy()
    return out


def _common(model: Model, most: int) -> int:
    """The smallest count from which the model's rows are ``most`` at most."""
    sizes = model.words.select("n").unionByName(model.extra.select("n")).groupBy("n").agg(F.count("*").alias("rows"))
    # counts from 2 ** 20 on are taken together
    total = sizes.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.sum("rows").alias("rows")).orderBy(F.desc("n")).toArrow()
    kept = np.cumsum(total["rows"].to_numpy()) <= most
    levels = total["n"].to_numpy()
    return 1 if kept.all() else int(levels[kept][-1]) if kept.any() else (1 << 20) + 1


def _asked(keys: list[np.ndarray], place: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of context: tokens that have it, the key of that state and the key of the prediction."""
    for d in range(1, depth + 1):
        at = np.flatnonzero(place >= d)
        yield at, keys[d - 1][at - 1], keys[d][at]


def _state(context: np.ndarray) -> np.ndarray:
    return joined(context, np.full(len(context), STATE, U))


def _sums(docs: DataFrame, model: Model, least: int, rare: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, with what the common part of the model says, and the keys that its rare part may hold.

    Keys are added up within a text: kind 0 is a word, 1 a state or a prediction.
    """
    spark = docs.sparkSession
    common = lambda rows: rows.where(F.col("n") >= least)
    held = _pieces(common(model.words), "n"), _pieces(common(model.extra), "value")
    bits = spark.sparkContext.broadcast(None if rare is None else _filter(rare.select("key")))
    shared, depth = model.tokens + 0.5 * (model.distinct + 1), model.depth

    def work(lists):
        words, extra = (Pieces([Table(*p.value, PIECE_BITS) for p in pieces]) for pieces in held)
        marked = lambda keys: np.zeros(len(keys), bool) if bits.value is None else _marked(bits.value, keys)
        for texts in lists:
            for lo, hi in chunks(texts):
                keys, place, text = _sequences(texts[lo:hi], depth)
                many, at = hi - lo, np.flatnonzero(place > 0)
                count = words.found(keys[0][at])
                unknown = count == 0
                base = np.bincount(text[at], np.log10((count.astype(np.float64) + 0.5) / shared), many)
                score = base.copy()
                open_ = at[unknown & marked(keys[0][at])]
                rest = [(np.zeros(len(open_), np.int8), keys[0][open_], text[open_])]
                live = np.ones(len(place), bool)
                for at_d, context, whole in _asked(keys, place, depth):
                    go = live[at_d]  # a longer context only where the shorter one may be a state
                    at_d, state, whole = at_d[go], _state(context[go]), whole[go]
                    left = extra.found(state).astype(np.float64)
                    maybe = (left == 0) & marked(state)
                    rest.append((np.ones(int(maybe.sum()), np.int8), state[maybe], text[at_d[maybe]]))
                    go = maybe | (left != 0)
                    at_d, whole, left = at_d[go], whole[go], left[go]
                    gain = extra.found(whole).astype(np.float64)
                    maybe = (gain == 0) & marked(whole)
                    rest.append((np.ones(int(maybe.sum()), np.int8), whole[maybe], text[at_d[maybe]]))
                    score += np.bincount(text[at_d], left + gain, many)
                    live = np.zeros(len(place), bool)
                    live[at_d] = True
                out = {"n_tokens": np.bincount(text[at], minlength=many), "n_known": np.bincount(text[at], ~unknown, many).astype(np.int64), "base_score": base, "score": score}
                if bits.value is not None:
                    kind, key, owner = (np.concatenate(c) for c in zip(*rest))
                    order = np.lexsort((key, kind, owner))
                    kind, key, owner = kind[order], key[order], owner[order]
                    new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0) | np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
                    at = pa.array(np.searchsorted(owner[new], np.arange(many + 1)).astype(np.int32))
                    for name, column in ((KINDS, kind[new]), (KEYS, _signed(key)[new]), (TIMES, np.diff(np.append(new, len(key))))):
                        out[name] = pa.ListArray.from_arrays(at, pa.array(column))
                yield range(lo, hi), out

    added = "n_tokens long, n_known long, base_score double, score double"
    return beside(docs, work, added if rare is None else f"{added}, {KINDS} array<tinyint>, {KEYS} array<bigint>, {TIMES} array<bigint>")


def _with_rare(docs: DataFrame, model: Model, least: int) -> DataFrame:
    """The common part of the model is broadcast; keys of its rare part, of which no text has many, are joined."""
    shared = model.tokens + 0.5 * (model.distinct + 1)
    below = F.col("n") < least
    root = model.words.where(below).select(F.lit(0).cast("tinyint").alias("kind"), "key", (F.log10((F.col("n") + 0.5) / F.lit(0.5))).alias("value"))
    rare = stored(root.unionByName(model.extra.where(below).select(F.lit(1).cast("tinyint").alias("kind"), "key", F.col("value").cast("double").alias("value"))), "rare")
    (row,) = free(docs, "row")
    found = stored(_sums(docs.withColumn(row, F.monotonically_increasing_id()), model, least, rare), "sums")
    asked = found.select(F.col(row).alias("row"), F.explode(F.arrays_zip(F.col(KINDS).alias("kind"), F.col(KEYS).alias("key"), F.col(TIMES).alias("times"))).alias("x")).select("row", "x.kind", "x.key", "x.times")
    root_, n, v = F.col("kind") == 0, F.col("times"), F.col("value")
    more = asked.join(rare, ["kind", "key"]).groupBy("row").agg(
        F.sum(F.when(root_, n).otherwise(0)).alias("_known"), F.sum(F.when(root_, n * v).otherwise(0.0)).alias("_base"), F.sum(n * v).alias("_score")
    ).withColumnRenamed("row", row)
    both = found.drop(KINDS, KEYS, TIMES).join(more, row, "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    # a word that the common part does not hold was counted as unseen: its addend is over that
    return both.select(*[c for c in docs.columns if c != "text"], "n_tokens", plus("n_known", "_known"), plus("base_score", "_base"), plus("score", "_score"))


def scored(docs: DataFrame, model: Model, most: int = MOST_BROADCAST) -> DataFrame:
    """The columns of ``docs`` but ``text``, with n_tokens, n_known, base_score and score (log10) per row.

    One row per row of ``docs``, repeated rows too. Words are parted by ASCII white space, A-Z lower-cased, and told apart
    by 64-bit hashes. Null and empty texts have one token, their end. The ``most`` commonest rows of the model, at most, are
    broadcast; the rest is joined with the keys of the texts that need it. Scores are the same up to rounding.
    """
    session(docs.sparkSession)
    given = docs.drop("n_tokens", "n_known", "base_score", "score", KINDS, KEYS, TIMES).withColumn("text", F.col("text").cast("binary"))
    least = _common(model, most)
    return _sums(given, model, 1, None) if least == 1 else _with_rare(given, model, least)


def held_out(base: int, held: int) -> Column:
    return F.coalesce(remainder("doc_id", base) == held, F.lit(False))
