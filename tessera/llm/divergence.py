"""Divergences between the sources of a language, and the terms that set a source apart, in exact whole numbers.

Texts are cut at byte level: a look-up table over the joined UTF-8 buffers of a batch marks the bytes of terms (A-Z, a-z and
all that is not ASCII), so boundaries are array differences. Slices are grouped by xxhash, and every slice is compared byte
by byte with the first of its group; slices that a collision put together are grouped by their bytes. What a task has
counted is added up before it is shuffled.

The terms that enough documents of a language hold are dealt into blocks by hash. A block is a sparse matrix, sources by
terms, in CSR form; the divergence of a source from all others is a segmented sum over its stored counts. Counts of zero are
never stored: their share has a closed form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, session, stored

#: Documents of a language that hold a term that is kept; terms reported for each source.
LEAST_DOCS, TERMS = 3, 200
#: Shares are whole numbers of so many parts.
PARTS = 1_000_000_000
#: Counted rows that a task holds before it passes them on, and stored counts in a block of terms.
HELD, BLOCK = 400_000, 40_000

IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts one after another, and where each row starts."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)), at - at[0]


def slices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, and start, end and row of each term."""
    data, at = _buffers(texts)
    inside = IS_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = at[(at > 0) & (at < len(data))]  # terms end with their text
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    starts = np.flatnonzero(first)
    return LOWER[data], starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, side="right") - 1


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[list[bytes], np.ndarray]:
    """The distinct slices, and for each slice which of them it is."""
    raw = low.tobytes()
    h = np.fromiter((hashed(raw[a:z]) for a, z in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    known = [raw[starts[i] : ends[i]] for i in first.tolist()]
    if not len(starts):
        return known, group
    size, model = ends - starts, first[group]
    wrong = size != size[model]
    check = np.flatnonzero(~wrong & (model != np.arange(len(model))))
    if len(check):
        n = size[check]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(begin, n)
        equal = low[np.repeat(starts[check], n) + step] == low[np.repeat(starts[model[check]], n) + step]
        wrong[check] = ~np.logical_and.reduceat(equal, begin)
    number: dict[bytes, int] = {}
    for i in np.flatnonzero(wrong).tolist():
        term = raw[starts[i] : ends[i]]
        if term not in number:
            number[term] = len(known)
            known.append(term)
        group[i] = number[term]
    return known, group


def _batch(texts: pa.Array, groups: np.ndarray) -> pa.Table:
    """group, term, occurrences and documents of a batch."""
    low, starts, ends, row = slices(texts)
    known, term = grouped(low, starts, ends)
    cell, n = np.unique(row * max(1, len(known)) + term, return_counts=True)
    row, term = cell // max(1, len(known)), cell % max(1, len(known))
    group = groups[row]
    order = np.lexsort((term, group))
    group, term, n = group[order], term[order], n[order]
    new = np.flatnonzero(np.diff(group, prepend=-1) | np.diff(term, prepend=-1)) if len(n) else np.empty(0, np.int64)
    total = np.add.reduceat(n, new) if len(new) else n
    docs = np.diff(np.append(new, len(n)))
    return pa.table({"group": group[new], "term": pa.array(known, pa.binary()).take(pa.array(term[new])), "n": total.astype(np.int64), "docs": docs.astype(np.int64)})


@frugal
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and docs of a task's rows, added up."""
    held: list[pa.Table] = []
    numbers: dict[tuple[str, str], int] = {}

    def added() -> pa.Table:
        return pa.concat_tables(held).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["group", "term", "n", "docs"])

    def passed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        names = list(numbers)
        for part in (0, 1):
            t = t.append_column(("lang", "source")[part], pa.array([x[part] for x in names], pa.string()).take(t["group"]))
        t = t.set_column(t.schema.get_field_index("term"), "term", t["term"].cast(pa.string()))
        yield from t.select(["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=20_000)

    for b in batches:
        groups = [numbers.setdefault(key, len(numbers)) for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        held.append(_batch(b.column(2), np.array(groups, np.int64)))
        if sum(t.num_rows for t in held) > HELD:
            held[:] = [added()]
            if held[0].num_rows > HELD // 2:
                yield from passed(held.pop())
                numbers.clear()
    if held:
        yield from passed(added())


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(PARTS * (count + 1) / total), by long division: exact for totals up to 9 * 10**15."""
    whole, left = np.divmod(np.asarray(count, np.int64) + 1, total)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _block(entries: pa.Table, sources: pa.Table) -> pa.Table:
    """Of a block of terms: sums of distances between its sources, and the distance of each stored count from its language.

    entries: source, term, n, in_lang (the term's count in the language); sources: source, total, lang_total, terms (kept
    terms of the language), with all sources of the language.
    """
    lang = sources["lang"][0].as_py()
    names = sorted(sources["source"].to_pylist(), key=lambda s: s.encode())
    number, many = {s: i for i, s in enumerate(names)}, len(names)
    total = np.zeros(many, np.int64)
    total[[number[s] for s in sources["source"].to_pylist()]] = sources["total"].to_numpy()
    size, every = sources["terms"][0].as_py(), sources["lang_total"][0].as_py()
    own = np.array([number[s] for s in entries["source"].to_pylist()], np.int64)
    coded = entries["term"].combine_chunks().dictionary_encode()
    term, width = np.asarray(coded.indices, np.int64), len(coded.dictionary)
    order = np.lexsort((term, own))
    own, term = own[order], term[order]
    sums = np.zeros((many, many), np.int64)
    far = np.empty(0, np.int64)
    ahead = np.empty(0, np.int64)
    if width:
        count, in_lang = entries["n"].to_numpy()[order], entries["in_lang"].to_numpy()[order]
        p, none = shares(count, total[own] + size), shares(np.zeros(many), total + size)
        start = np.searchsorted(own, np.arange(many + 1))
        filled = np.flatnonzero(np.diff(start))
        for g in range(many):
            mine = slice(start[g], start[g + 1])
            row = np.full(width, none[g])
            row[term[mine]] = p[mine]
            at = row[term]
            sums[g, filled] = np.add.reduceat(_distance(at, p) - _distance(at, none[own]), start[filled])
            value, times = np.unique(p[mine], return_counts=True)
            sums[g] += (_distance(value[:, None], none[None, :]) * times[:, None]).sum(axis=0)
            sums[g] += (width - (start[g + 1] - start[g])) * _distance(none[g], none)
        q = shares(in_lang, every + size)
        ahead = np.flatnonzero(p > q)
        far = _distance(p[ahead], q[ahead])
    g, h = np.nonzero(~np.eye(many, dtype=bool))
    pick = pa.array(names, pa.string())
    source = pa.concat_arrays([pick.take(pa.array(g)), pick.take(pa.array(own[ahead]))])
    item = pa.concat_arrays([pick.take(pa.array(h)), coded.dictionary.cast(pa.string()).take(pa.array(term[ahead]))])
    part = pa.array(["pair"] * len(g) + ["term"] * len(ahead), pa.string())
    return pa.table({"lang": pa.array([lang] * len(part), pa.string()), "source": source, "part": part, "item": item, "value": np.concatenate([sums[g, h], far])})


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it); null text, lang and source are empty ones."""
    session(docs.sparkSession)
    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    counted = own.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergences(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value and rank: every other source (`pair`), and the TERMS terms most ahead (`term`).

    ``docs`` has text, lang and source; one row is one document, repeated rows too, and other columns are not looked at.
    A source without kept terms has a row for each other source of its language, a language with one source no pairs, an
    empty table no rows. Ties go by the items' bytes. Results do not depend on ``block``. A task holds a block of counts
    and the square of the sources of its language, which is what the pairs are.
    """
    spark = docs.sparkSession
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("held", F.sum("docs").over(of_term)).withColumn("in_lang", F.sum("n").over(of_term)).withColumn("lead", F.min("source").over(of_term) == F.col("source"))
    kept = stored(counts.where(F.col("held") >= LEAST_DOCS).select("lang", "source", "term", "n", "in_lang", "lead"), "kept_terms")
    blocks = max(1, -(-kept.count() // block))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("lead").cast("long")).alias("leads"))
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct().join(totals, ["lang", "source"], "left")
    of_lang = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    sources = groups.select("lang", "source", zero("total").alias("total"), F.sum(zero("leads")).over(of_lang).alias("terms"), F.sum(zero("total")).over(of_lang).alias("lang_total"))
    sources = sources.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    entries = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "source", "term", "n", "in_lang")
    found = entries.groupBy("lang", "block").cogroup(sources.groupBy("lang", "block")).applyInArrow(_block, "lang string, source string, part string, item string, value long")
    found = stored(found, "distances")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    ahead = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TERMS)
    return pairs.unionByName(ahead)
