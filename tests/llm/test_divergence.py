"""Source divergences against plain Python, collisions and SQL."""

import collections
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def expected(rows, least=3):
    count, held, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", [lowered(w) for w in TERM.findall(text or "")]
        groups.add((lang, source))
        count[lang, source].update(words)
        held[lang].update(set(words))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = [s for k, s in groups if k == lang]

        def share(names):
            c = collections.Counter()
            for s in names:
                c.update({t: count[lang, s][t] for t in kept})
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}, c

        p, c = share([source])
        pairs = [(s, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for s in own if s != source for q in [share([s])[0]]]
        q = share(own)[0]
        terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if c[t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, v, k) for k, (item, v) in enumerate(found, 1) if part == "pair" or k <= 200}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["Der", "das", "éa", "Éa", "o", "x1y", "naïve", "中文", "a_b", "don't", "K", "Zz", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(12)]]
    out = []
    for i in range(150):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "S3", "é", None])
        out.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), lang, source, "clash", 1))
    out += [(1, None, "en", "only nulls", None, None), (2, "", "fr", "a", None, None), (3, "12 34", "fr", "b", None, None), (4, "alone", "it", "a", None, None), (5, "end", "en", "s1", None, 0), (6, "start\x00x", "en", "s1", None, 0)]
    return out


def test_values_are_those_of_plain_counts(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    want = expected([r[1:4] for r in rows])
    for block in (40_000, 37):
        got = [tuple(r) for r in divergence.divergences(docs, block).collect()]
        assert len(got) == len(want) and set(got) == want
    assert ("fr", "a", "pair", "b", 0, 1) in want and not any(w[0] == "it" for w in want)


def test_empty_table(spark):
    assert divergence.divergences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_collisions_are_parted_by_their_bytes():
    texts = pa.array(["ab Cd ab", None, "cd", "efg", "ab"], pa.large_string())
    low, starts, ends, row = divergence.slices(texts)
    want = [b"ab", b"cd", b"ab", b"cd", b"efg", b"ab"]
    assert row.tolist() == [0, 0, 0, 2, 3, 4]
    for hashed in (lambda b: 7, len, hash):
        known, group = divergence.grouped(low, starts, ends, lambda b: hashed(b) % 2**63)
        assert [known[g] for g in group] == want and len({*group.tolist()}) == 3


def test_adjacent_texts_do_not_run_together():
    low, starts, ends, row = divergence.slices(pa.array(["ab", "", "cd", "e f", "g"]).slice(1))
    assert [bytes(low[a:z]) for a, z in zip(starts, ends)] == [b"cd", b"e", b"f", b"g"] and row.tolist() == [1, 2, 2, 3]


def test_long_division_is_exact():
    rng = random.Random(1)
    for _ in range(2000):
        total = rng.choice([1, 2, 10**9, 9 * 10**15, rng.randrange(1, 9 * 10**15)])
        c = rng.randrange(0, total)
        assert int(divergence.shares(np.array([c]), total)[0]) == 1 + 10**9 * (c + 1) // total


def test_block_sums_over_all_terms():
    sources = pa.table({"lang": ["x"] * 3, "source": ["b", "a", "c"], "total": [5, 3, 0], "terms": [4] * 3, "lang_total": [8] * 3})
    entries = pa.table({"source": ["a", "b", "b"], "term": ["t", "t", "u"], "n": [3, 1, 4], "in_lang": [4, 4, 4]})
    got = divergence._block(entries, sources).to_pandas()
    p = {s: [1 + 10**9 * (n + 1) // (total + 4) for n in counts] for s, counts, total in (("a", [3, 0], 3), ("b", [1, 4], 5), ("c", [0, 0], 0))}
    for r in got[got.part == "pair"].itertuples():
        assert r.value == sum((x - y) ** 2 // y for x, y in zip(p[r.source], p[r.item]))
    assert isinstance(got, pd.DataFrame) and (got.part == "pair").sum() == 6
