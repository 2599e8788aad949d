"""Periodic runs against every lag compared word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import periods, queries

SCHEMA = "doc_id long, text string, runs string, source string"


def plain_runs(x):
    best = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def some_text(rng, n):
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.4:
            out += [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 40))]
        else:
            block = [rng.choice(["a", "b", "é", "the"][: rng.choice([1, 2, 4])]) for _ in range(rng.randrange(1, 14))]
            out += block * rng.randrange(1, 14) + block[: rng.randrange(len(block))]
    return "".join(x + rng.choice([" ", " ", "\n", "\t \x0b"]) for x in out[:n])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, some_text(rng, rng.randrange(0, 260)), "x", "s") for i in range(120)]
    return out + [(None, "a " * 30, "x", None), (900, None, None, "s"), (901, "", "x", "s"), (902, " \n ", "x", "s"), (7, out[7][1], "x", "s"), (903, "a a a\x1ca " * 30, "x", "s"), (904, "w " * 3000, "x", "s")]


def got(frame):
    rows = periods.digests(frame).collect()
    return sorted(([r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256] for r in rows), key=str)


def test_runs_are_those_of_every_lag(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(([r[0], *expected(r[0], r[1])] for r in rows), key=str)
    assert got(periods.periodic_runs(periods.planted(docs))) == want
    assert got(periods.periodic_runs(periods.planted(docs), long_bytes=300, lags=5)) == want
    assert sum(w[1] > 0 for w in want) > 40


def test_ranges_of_lags_together_show_all_runs():
    rng = random.Random(2)
    for _ in range(60):
        x = np.array([hash(w) % 1000 for w in some_text(rng, 200).split()])
        parts = {r for a in range(1, 70, 9) for r in periods.runs_of([x], a, a + 8)[0]}
        assert sorted(parts, key=lambda r: (r[0], r[2])) == periods.runs_of([x])[0] == plain_runs(x.tolist())


def test_columns_stay_and_empty_tables_pass(spark, rows):
    found = periods.periodic_runs(spark.createDataFrame(rows[:3], SCHEMA))
    assert found.columns == ["doc_id", "source", "runs", "collapsed"]
    empty = periods.periodic_runs(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.dtypes == found.dtypes


def test_query_is_the_contract_on_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where(F.octet_length("text") < 6000).collect()
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for d in docs:
        assert tuple(rows[d.doc_id])[1:] == expected(d.doc_id, d.text)
