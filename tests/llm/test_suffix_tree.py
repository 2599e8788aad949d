"""The suffix tree against a plain recursion over dictionaries, and its gain on held-out texts."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, suffix_tree

SCHEMA = "doc_id long, text string, n_tokens string, row string"
START, END = object(), object()


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


class Plain:
    """The tree by its definition, one dictionary a context."""

    def __init__(self, texts, depth, context, cost):
        seqs = [[START, *tokens(t)] for t in texts]
        self.c = collections.Counter(w for s in seqs for w in s[1:])
        self.n, self.v, self.depth = sum(self.c.values()), len(self.c), depth
        after = collections.defaultdict(collections.Counter)
        for s in seqs:
            for i in range(1, len(s)):
                for d in range(1, depth + 1):
                    if i - d >= 0:
                        after[tuple(s[i - d : i])][s[i]] += 1
        self.states = {}
        for d in range(1, depth + 1):
            for ctx, own in after.items():
                total = sum(own.values())
                if len(ctx) != d or total < context or d > 1 and ctx[1:] not in self.states:
                    continue
                if d > 1 and not self.counted(after, ctx, context):
                    continue
                once, left = sum(c == 1 for c in own.values()), len(own) / total
                gain = sum(c * math.log(((c - 1) / total + left * self.p(ctx[1:], w)) / self.p(ctx[1:], w)) for w, c in own.items() if c > 1)
                if any(c > 1 for c in own.values()) and gain + once * math.log(left) >= cost * (sum(c > 1 for c in own.values()) + 1):
                    self.states[ctx] = own

    def counted(self, after, ctx, context):
        """A longer context grows from a counted one: its first words are a candidate too, with a retained suffix."""
        return len(ctx) == 2 or ctx[1:-1] in self.states

    def p(self, ctx, w):
        while ctx and ctx not in self.states:
            ctx = ctx[1:]
        if not ctx:
            return (self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))
        own = self.states[ctx]
        total = sum(own.values())
        return max(own[w] - 1, 0) / total + len(own) / total * self.p(ctx[1:], w)

    def score(self, text):
        s = [START, *tokens(text)]
        return sum(math.log10(self.p(tuple(s[max(0, i - self.depth) : i]), s[i])) for i in range(1, len(s)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    phrases = ["in the end it is", "The cat sat on the mat", "der Hund und die Katze", "a b a b a c"]
    out = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(0, 12)):
            words += rng.choice(phrases).split() if rng.random() < 0.7 else [rng.choice("pqrstuv") + str(rng.randrange(30))]
        out.append((i, " ".join(words), "x", "y"))
    return out + [(None, "in the end", None, None), (500, None, None, None), (501, "", None, None), (502, "never seen words", None, None), (3, out[3][1], None, None), (503, "the cat " * 2000, None, None)]


@pytest.mark.parametrize(("depth", "cost"), [(1, 0.5), (2, 0.5), (3, -2.0)])
def test_scores_are_those_of_the_recursion(spark, rows, depth, cost):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = suffix_tree.fit(suffix_tree.teaching(docs, 5, 1), depth, 6, cost)
    taught = [r[1] for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    plain = Plain(taught, depth, 6, cost)
    assert (model.tokens, model.distinct) == (plain.n, plain.v)
    want = sorted((str(r[0]), len(tokens(r[1])), sum(plain.c[w] > 0 for w in tokens(r[1])), sum(math.log10((plain.c[w] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for w in tokens(r[1])), plain.score(r[1])) for r in rows)
    assert len(plain.states) > 10 and (depth == 1 or any(len(s) == depth for s in plain.states))
    for most in (10_000_000, 40, 0):
        scored = suffix_tree.scored(docs, model, most)
        assert scored.columns == ["doc_id", "row", "n_tokens", "n_known", "base_score", "score"]
        got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in scored.collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
        far = [(g, w) for g, w in zip(got, want) if abs(g[4] - w[4]) > 1e-6 * g[1] + 1e-6 * abs(w[4])]
        assert not far, far


def test_predictions_add_up_to_one():
    plain = Plain(["a b a c a b", "b a b a b a c", "c c a"], 2, 2, -100)
    assert len(plain.states) > 3
    for ctx in plain.states:
        assert abs(sum(plain.p(ctx, w) for w in plain.c) + plain.p(ctx, "unseen") - 1) < 1e-12


def test_keys_are_sparks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63, (2, 50))
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long").select(F.xxhash64("a", "b")).collect()
    assert [r[0] for r in rows] == suffix_tree.joined(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    model = suffix_tree.fit(suffix_tree.teaching(docs, 5, 1))
    assert suffix_tree.scored(docs, model).count() == 0 and model.tokens == 0
    one = suffix_tree.scored(spark.createDataFrame([(1, "a b", None, None)], SCHEMA), model).first()
    assert (one.n_tokens, one.n_known) == (3, 0)


def test_held_out_texts_gain(spark):
    rows = queries.op13_suffix_tree_lm(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_word_hashes_tell_words_apart():
    """Same words, same hashes, wherever they stand; A-Z counts as a-z; lengths round the blocks and very long words."""
    rng = random.Random(6)
    words = {"".join(rng.choice("abé中") for _ in range(n)) for n in (*range(1, 26), 63, 64, 65, 66, 500) for _ in range(30)} | {"a\x1cb", "a", "aa", "A\x00", "a\x00\x00"}
    words = sorted({w.lower() if w.isascii() else w for w in words})
    h, owner = suffix_tree.word_hashes([" \t".join(words).encode(), None, b"", b"\n x \x0b", " ".join(w.upper() if w.isascii() else w for w in reversed(words)).encode()])
    n = len(words)
    assert len(h) == 2 * n + 1 and owner.tolist() == [0] * n + [3] + [4] * n
    assert h[:n].tolist() == h[n + 1 :][::-1].tolist() and len(set(h[:n].tolist())) == n
    assert suffix_tree.word_hashes([])[0].tolist() == [] and suffix_tree.word_hashes([None, b" "])[0].tolist() == []
