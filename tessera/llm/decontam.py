"""Benchmark passages in documents: q-gram lemma filter over diagonal bands, then banded alignment.

Texts are lower-cased, white space is one blank, and bytes of UTF-8 are compared. Benchmark items
are cut into windows of WINDOW bytes that begin every STRIDE bytes, and of WORDS words that begin at
every word, so that a verbatim passage of WORDS words, or of WINDOW + STRIDE - 1 bytes, is found
wherever it begins. A window of m bytes that occurs with k edits shares m + 1 - Q(k + 1) of its
q-grams or more with the text, all on k + 1 neighbouring diagonals, hence in one of the bands of two
strips of as many diagonals as the largest k. Windows with enough shared q-grams in a band are
aligned within its diagonals. Items, not windows, are indexed, so overlapping windows cost no memory; windows that
repeat within an item are indexed once, and q-grams that are common on both sides are met in pieces of MOST_ENTRIES.

A benchmark of up to BLOCK_BYTES is one broadcast block. A larger one is cut into blocks; then a broadcast bitmap of all
its q-grams first picks the documents that hold enough of them in a short stretch, and only those pass by the blocks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, frugal, kept, session, stored
from .words import U, chunks

Q, WINDOW, RATE = 10, 96, 0.08
#: Bytes between the beginnings of windows, and the words of the windows that begin at every word.
STRIDE, WORDS = 8, 13
#: No window is longer: longer passages hold a window of WINDOW bytes.
LONGEST = WINDOW + STRIDE - 1
#: Benchmark bytes of a block, of which a worker holds the index.
BLOCK_BYTES = 8_000_000
TABLE_BITS = 22
#: Meetings of a text's and the items' q-grams that are looked at together; the bits of the bitmap over larger benchmarks, at most.
MOST_ENTRIES, MOST_BITS = 4_000_000, 27
#: No occurrence of a window is longer.
REACH = LONGEST + int(RATE * LONGEST)
_BLANK = re.compile(r"\s+")


def plain(text) -> bytes:
    """The compared form of a text; null is empty."""
    return " ".join(text.lower().split()).replace("\0", " ").encode("utf-8", "replace") if text else b""


def qgrams(data: bytes) -> np.ndarray:
    """A 64-bit code of the Q bytes from each position."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, U)
    head = np.ndarray(n, "<u8", data, 0, (1,))
    tail = np.ndarray(n, "<u2", data, 8, (1,))
    code = (head * U(0x9E3779B97F4A7C15)) ^ (tail.astype(U) * U(0xC2B2AE3D27D4EB4F))
    return code * U(0xD6E8FEB86659FD93)


def cuts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and whether it is one of the half-overlapping ones, of an item's windows by start."""
    last = max(0, len(data) - WINDOW)
    start = np.append(np.arange(0, last, STRIDE), last)
    blank = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begin, end = np.append(0, blank + 1), np.append(blank, len(data))
    begin, size = begin[: max(0, len(begin) - WORDS + 1)], end[WORDS - 1 :] - begin[: max(0, len(begin) - WORDS + 1)]
    fits = (size >= Q) & (size <= LONGEST)
    start, size = np.append(start, begin[fits]), np.append(np.full(len(start), min(WINDOW, len(data))), size[fits])
    key = np.unique(start * (LONGEST + 1) + size)
    start, size = key // (LONGEST + 1), key % (LONGEST + 1)
    return start, size, (size == min(WINDOW, len(data))) & ((start % (WINDOW // 2) == 0) | (start == last))


def budgets(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits that windows of these sizes may hold, and the q-grams that they share with a text all the same."""
    edits = np.maximum(0, np.minimum((RATE * size).astype(np.int64), (size - Q) // Q - 1))
    return edits, size + 1 - Q * (edits + 1)


def distinct(data: bytes, start: np.ndarray, size: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows whose text no earlier window of the item has."""
    seen, new = set(), np.ones(len(start), bool)
    for i, (a, n) in enumerate(zip(start.tolist(), size.tolist())):
        text = data[a : a + n]
        if text in seen:
            new[i] = False
        else:
            seen.add(text)
    return start[new], size[new], half[new]


def covered(length: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of an item's q-grams that lie within one of the windows."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + size - Q + 1, -1)
    return np.flatnonzero(np.cumsum(change) > 0)


class Cut:
    """The windows' texts, cut when asked for."""

    def __init__(self, data: list[bytes], owner: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.data, self.owner, self.start, self.size = data, owner, start, size

    def __len__(self) -> int:
        return len(self.owner)

    def __getitem__(self, w: int) -> bytes:
        at = int(self.start[w])
        return self.data[self.owner[w]][at : at + int(self.size[w])]


class Windows:
    """The windows of a block of benchmark items, with the q-gram index of the items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.names, self.short, data = [], [], []
        for item, text in items:
            plainly = plain(text)
            if len(plainly) >= Q:
                self.names.append(item)
                data.append(plainly)
            elif plainly:
                self.short.append((item, plainly))
        parts = [distinct(x, *cuts(x)) for x in data] or [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))]
        self.start, self.size, self.half = (np.concatenate(x) for x in zip(*parts))
        n = [len(x[0]) for x in parts] if data else []
        self.first_window = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.text = Cut(data, np.repeat(np.arange(len(data)), n), self.start, self.size)
        self.edits, self.need = budgets(self.size)
        self.least = np.minimum.reduceat(self.need, self.first_window[:-1]) if data else np.empty(0, np.int64)
        self.step = int(max(1, self.edits.max(initial=1)))
        self.longest = max(map(len, data), default=0)
        places = [covered(len(x), p[0], p[1]) for x, p in zip(data, parts)]
        codes = [qgrams(x)[at] for x, at in zip(data, places)]
        code = np.concatenate(codes) if codes else np.empty(0, U)
        order = np.argsort(code, kind="stable")
        self.place = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order]
        self.offset = np.concatenate(places)[order] if codes else np.empty(0, np.int64)
        self.code, self.first, self.times = np.unique(code[order], return_index=True, return_counts=True)
        self.rank = None
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[(self.code >> U(64 - TABLE_BITS)).astype(np.int64)] = True

    def bands(self, data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(item, lowest, highest diagonal, windows) of every band in which windows share enough q-grams.

        Stretches of the text and ranges of items are taken in turn, so that about MOST_ENTRIES meetings are held at once;
        stretches overlap by an occurrence, whose bands may come twice.
        """
        grams = qgrams(data)
        at = np.flatnonzero(self.seen[(grams >> U(64 - TABLE_BITS)).astype(np.int64)])
        if not len(at) or not len(self.code):
            return
        slot = np.minimum(np.searchsorted(self.code, grams[at]), len(self.code) - 1)
        real = self.code[slot] == grams[at]
        at, slot = at[real], slot[real]
        total = np.cumsum(self.times[slot])
        lo = 0
        while lo < len(at):
            cut = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + MOST_ENTRIES, side="right"))
            hi = max(cut, int(np.searchsorted(at, at[lo] + 2 * REACH)))
            yield from self._stretch(at[lo:hi], slot[lo:hi], len(data))
            if hi >= len(at):
                return
            lo = max(lo + 1, int(np.searchsorted(at, at[hi] - REACH)))

    def _stretch(self, at: np.ndarray, slot: np.ndarray, size: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        pieces = -(-int(self.times[slot].sum()) // (2 * MOST_ENTRIES))
        if pieces < 2:
            yield from self._bands(at, slot, self.first[slot], self.times[slot], size)
            return
        n = len(self.names)
        if self.rank is None:
            self.rank = np.repeat(np.arange(len(self.code)), self.times) * n + self.place
        bounds = np.unique(np.linspace(0, n, pieces + 1).astype(np.int64))
        for i, j in zip(bounds[:-1], bounds[1:]):
            first = np.searchsorted(self.rank, slot * n + i)
            yield from self._bands(at, slot, first, np.searchsorted(self.rank, slot * n + j) - first, size)

    def _bands(self, at: np.ndarray, slot: np.ndarray, first: np.ndarray, times: np.ndarray, size: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(first, times) + inside
        item, offset = self.place[entry], self.offset[entry]
        strip = (np.repeat(at, times) - offset + self.longest) // self.step
        span = (size + self.longest) // self.step + 2
        key, group, count = np.unique(item * span + strip, return_inverse=True, return_counts=True)
        if not len(key):
            return
        pair = np.append(key[1:] == key[:-1] + 1, False)
        total = count + np.where(pair, np.append(count[1:], 0), 0)
        keep = total >= self.least[key // span]
        wanted = keep | np.append(False, keep[:-1] & pair[:-1])
        held = np.flatnonzero(wanted[group])
        held = held[np.lexsort((offset[held], group[held]))]
        group, offset = group[held], offset[held]
        chosen = np.flatnonzero(keep)
        lo = np.searchsorted(group, chosen)
        hi = np.searchsorted(group, chosen + pair[chosen], side="right")
        for g, a, z in zip(chosen.tolist(), lo.tolist(), hi.tolist()):
            i, t = divmod(int(key[g]), span)
            shared = np.unique(offset[a:z])
            w0, w1 = int(self.first_window[i]), int(self.first_window[i + 1])
            starts = self.start[w0:w1]
            w0, w1 = w0 + int(np.searchsorted(starts, shared[0] - LONGEST)), w0 + int(np.searchsorted(starts, shared[-1], side="right"))
            start = self.start[w0:w1]
            enough = np.searchsorted(shared, start + self.size[w0:w1] - Q, side="right") - np.searchsorted(shared, start) >= self.need[w0:w1]
            if enough.any():
                low = t * self.step - self.longest
                yield i, low, low + 2 * self.step - 1, w0 + np.flatnonzero(enough)


def align(pattern: bytes, data: bytes, low: int, high: int, most: int) -> tuple[int, int]:
    """(edits, end) of the best occurrence of ``pattern`` in ``data`` that starts on diagonals low to high.

    Only diagonals within ``most`` of them are filled. Edits above ``most`` are returned as most + 1.
    """
    m, d0 = len(pattern), low - most
    width = high - low + 2 * most + 1
    lane = np.arange(width)
    text = np.frombuffer(data, np.uint8)
    far = most + 1
    position = lane + d0  # text position before pattern byte 0
    row = np.where((position >= 0) & (position <= len(text)), 0, far)
    for i in range(m):
        at = position + i
        inside = (at >= 0) & (at < len(text))
        differs = np.where(inside, text[np.clip(at, 0, max(0, len(text) - 1))] != pattern[i], True) if len(text) else np.ones(width, bool)
        new = np.where(inside, row + differs, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a pattern byte without a partner
        new = np.minimum.accumulate(new - lane) + lane  # text bytes without a partner
        row = np.minimum(new, far)
        if row.min() > most:
            return far, -1
    best = int(row.argmin())
    return int(row[best]), int(position[best] + m)


def passages(texts: list, windows: Windows) -> Iterator[list[tuple[int, int, int, int]]]:
    """For each text its (item, start byte, end byte, edits) regions in the compared form, best window per item and place."""
    for lo, hi in chunks(texts):
        parts = [plain(t) for t in texts[lo:hi]]
        gap = b"\0" * WINDOW * 2
        starts = np.cumsum([0] + [len(p) + len(gap) for p in parts])
        data = gap.join(parts) + gap
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in parts]
        for i, low, high, some in windows.bands(data):
            done: list[tuple[int, int]] = []  # parts of the item found in this band
            half = windows.half[some]
            for w in some[half].tolist() + some[~half].tolist():
                first, size, most = int(windows.start[w]), int(windows.size[w]), int(windows.edits[w])
                if any(a <= first and first + size <= z for a, z in done):
                    continue
                pattern = windows.text[w]
                begin = data.find(pattern, max(0, low + first), max(0, high + first) + size + most)
                edits, end = (0, begin + size) if begin >= 0 else align(pattern, data, low + first, high + first, most)
                if edits <= most:
                    done = united(done, first, first + size)
                    doc = int(np.searchsorted(starts, max(0, end - 1), side="right")) - 1
                    base = int(starts[doc])
                    found[doc].append((windows.names[i], max(0, end - size - base), end - base, edits))
        for i, p in enumerate(parts):
            for item, short in windows.short:
                for m in re.finditer(rb"(?<!\S)" + re.escape(short) + rb"(?!\S)", p):
                    found[i].append((item, m.start(), m.end(), 0))
        for rows in found:
            yield joined(rows)


def united(parts: list[tuple[int, int]], first: int, end: int) -> list[tuple[int, int]]:
    """The parts with one more; overlapping ones are one."""
    near = [p for p in parts if p[0] < end and first < p[1]]
    return [p for p in parts if p not in near] + [(min([first, *(a for a, _ in near)]), max([end, *(z for _, z in near)]))]


def joined(rows: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping regions of an item as one, with the most edits of its windows."""
    out: list[tuple[int, int, int, int]] = []
    for item, start, end, edits in sorted(set(rows)):
        if out and out[-1][0] == item and start <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(end, out[-1][2]), max(edits, out[-1][3]))
        else:
            out.append((item, start, end, edits))
    return out


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """item_id (the smallest), text and copies of the benchmark's different texts; empty and null ones hold no passage."""
    own = benchmark.where("text is not null and text <> '' and item_id is not null")
    return own.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies")).select("item_id", "text", "copies")


class Block:
    """A part of the benchmark, broadcast; a worker builds its index once."""

    def __init__(self, spark, items: list[tuple[int, str]]):
        self.name, self.items = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    def windows(self) -> Windows:
        return kept(("windows", self.name), lambda: Windows(self.items.value))


def item_blocks(items: DataFrame) -> Iterator[Block]:
    """Blocks of BLOCK_BYTES at most, or one item. The driver holds one block at a time."""
    block, size, spark = [], 0, items.sparkSession
    for r in items.select("item_id", "text").toLocalIterator():
        n = len(r.text.encode("utf-8", "replace"))
        if block and size + n > BLOCK_BYTES:
            yield Block(spark, block)
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield Block(spark, block)


@frugal
def _bits(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Words of the q-gram bitmap, and as word -1 the fewest q-grams that an occurrence of a window shares (0 of short items)."""
    seen, least = np.zeros(1 << bits, bool), LONGEST
    for b in batches:
        for text in b.text:
            data = plain(text)
            if data:
                seen[(qgrams(data) >> U(64 - bits)).astype(np.int64)] = True
                least = min(least, int(budgets(cuts(data)[1])[1].min())) if len(data) >= Q else 0
    packed = np.packbits(seen, bitorder="little").view(np.int64)
    word = np.flatnonzero(packed)
    yield pd.DataFrame({"word": np.append(word, -1), "mask": np.append(packed[word], least)})


class Bitmap:
    """The q-grams of a whole benchmark, for a first look at texts."""

    def __init__(self, items: DataFrame):
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.bits = min(MOST_BITS, max(16, (16 * size).bit_length()))
        words = items.select("text").mapInPandas(partial(_bits, bits=self.bits), "word long, mask long")
        both = words.groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"), F.min("mask").alias("least")).toPandas()
        self.least = int(both.least[both.word < 0].min()) if (both.word < 0).any() else LONGEST
        both = both[both.word >= 0]
        packed = np.zeros(1 << (self.bits - 6), np.int64)
        packed[both.word.to_numpy()] = both["mask"].to_numpy()
        self.packed = items.sparkSession.sparkContext.broadcast(packed)

    def suspects(self, texts: list) -> np.ndarray:
        """Whether a text may hold a passage: as many known q-grams as any window needs, within one occurrence's length."""
        packed, out = self.packed.value, np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            data = plain(text)
            if self.least <= 0:
                out[i] = bool(data)
                continue
            code = (qgrams(data) >> U(64 - self.bits)).astype(np.int64)
            known = (packed[code >> 6] >> (code & 63)) & 1
            total = np.concatenate([[0], np.cumsum(known)])
            end = np.minimum(np.arange(len(known)) + REACH, len(known))
            out[i] = len(known) > 0 and int((total[end] - total[:-1]).max()) >= self.least
        return out


def _parted(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may hold a passage, written out, and the others."""
    bitmap = Bitmap(items)

    @frugal
    def pick(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bitmap.suspects(b.column("text").to_pylist()) == wanted))

    return stored(docs.mapInArrow(partial(pick, wanted=True), docs.schema), "suspects"), docs.mapInArrow(partial(pick, wanted=False), docs.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: one row per document, different benchmark text and place.

    start and end are byte positions in the compared form. Items of the same text are reported as the smallest of their ids
    (``distinct_items``). Null and empty texts hold nothing. Items below Q bytes count where they stand as whole words.
    Repeated rows are reported each, with their ids as they are, null ones too.
    """
    spark = session(docs.sparkSession)
    own, items = docs.select("doc_id", "text"), stored(distinct_items(benchmark), "items")
    kind = items.schema["item_id"].dataType.simpleString()
    added = f"item_id {kind}, start long, end long, edits int"

    def found(rows: DataFrame, block: Block) -> DataFrame:
        def work(lists):
            windows = block.windows()
            for texts in lists:
                hits = [(i, *r) for i, rs in enumerate(passages(texts, windows)) for r in rs]
                yield [h[0] for h in hits], {n: [h[k] for h in hits] for k, n in enumerate(("item_id", "start", "end", "edits"), 1)}

        return beside(rows, work, added)

    blocks = list(item_blocks(items))
    if len(blocks) > 1:
        own, _ = _parted(own, items)
    out = None
    for block in blocks:
        part = found(own, block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {added}")
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no benchmark passage is found.

    Rows are judged by their own texts, whatever their ids; null and empty texts stay.
    """
    session(docs.sparkSession)
    items = stored(distinct_items(benchmark), "items")

    def dropped(rows: DataFrame, block: Block) -> DataFrame:
        @frugal
        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = block.windows()
            for b in batches:
                yield b.filter(pa.array([not r for r in passages(b.column("text").to_pylist(), windows)], pa.bool_()))

        return rows.mapInArrow(drop, docs.schema)

    blocks = list(item_blocks(items))
    if not blocks:
        return docs
    if len(blocks) == 1:
        return dropped(docs, blocks[0])
    some, others = _parted(docs, items)
    for block in blocks:
        some = stored(dropped(some, block), "clean")
    return some.unionByName(others)
