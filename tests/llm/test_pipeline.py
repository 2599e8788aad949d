"""The corpus pipeline against a brute-force chain, and its language model against plain counting."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import brute_indicators, brute_jp, weights

from tessera.llm import langid

corpus_pipeline = pytest.importorskip("corpus_pipeline")

TONGUES = {"aa": "abcdefgh", "bb": "mnopqrst"}


def words(lang, r, n):
    return ["".join(r.choice(TONGUES[lang]) for _ in range(r.randint(3, 7))) for _ in range(n)]


def corpus():
    r, rows, labels = random.Random(11), [], []
    passage = " ".join(words("aa", r, 20))
    for i in range(80):
        lang = ("aa", "bb")[i % 2]
        text = words(lang, r, 60)
        bad = i % 5 == 0
        if bad:
            text = [w.upper() + "!!!" for w in text]
        rows.append((i, " ".join(text), lang, f"s{i % 3}"))
        if i % 4 != 3:
            labels.append((i, int(not bad), 0))
    for k, i in enumerate((1, 2, 3, 1)):  # near copies, a copy, a copy of a copy
        text = rows[i][1].split()
        if k != 3:
            text[30] = "xyzzy"
        rows.append((100 + k, " ".join(text), rows[i][2], "s0"))
    rows.append((110, " ".join(words("aa", r, 30)) + " " + passage.upper() + " " + " ".join(words("aa", r, 30)), "aa", "s1"))
    edited = passage.split()
    edited[5] = edited[5][:-1] + "z"
    rows.append((111, " ".join(words("aa", r, 30) + edited + words("aa", r, 30)), "aa", "s1"))
    rows.append((112, " ".join("".join(r.choice("жщюяэйъ") for _ in range(r.randint(3, 7))) for _ in range(60)), None, "s2"))
    return rows, labels, [(1, passage), (2, " ".join(words("bb", r, 20)))]


def brute_quality(rows, labels):
    """Ids that a naive Bayes SVM over the same indicators, solved in plain Python, gives a margin of 0 or more."""
    import zlib

    label = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    sets = {i: brute_indicators(t) for i, t, *_ in rows}
    count = {y: Counter(f for i in label if label[i] == y for f in sets[i]) for y in (0, 1)}
    every = set(count[0]) | set(count[1])
    total = {y: sum(count[y].values()) + 1 for y in (0, 1)}
    ratio = {f: math.log((count[1][f] + 1) / total[1]) - math.log((count[0][f] + 1) / total[0]) for f in every}
    unit = {}
    for i, s in sets.items():
        v = {f: ratio[f] for f in s if f in ratio}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        unit[i] = {f: x / size for f, x in v.items()}
    w, alpha = defaultdict(float), dict.fromkeys(label, 0.0)
    for _ in range(60):
        for i, y in label.items():
            s = 2 * y - 1
            gradient = s * sum(w[f] * x for f, x in unit[i].items()) - 1
            new = min(1.0, max(0.0, alpha[i] - gradient / max(1e-9, sum(x * x for x in unit[i].values()))))
            for f, x in unit[i].items():
                w[f] += (new - alpha[i]) * s * x
            alpha[i] = new
    return {i for i in unit if sum(w[f] * x for f, x in unit[i].items()) >= 0}


def grams(text):
    b = " ".join(text.lower().split()).encode()
    return [b[i : i + 4] for i in range(len(b) - 3)]


def brute_language(rows):
    """Ids whose text is likelier in one of the languages than as noise, by plain gram counts."""
    counts = defaultdict(Counter)
    for _, t, lang, _ in rows:
        if lang:
            counts[lang].update(grams(t))
    kept = set()
    for i, t, *_ in rows:
        like = {}
        for lang, c in counts.items():
            total = sum(c.values()) + 0.5 * langid.GRAMS
            like[lang] = sum(math.log((1 - langid.NOISE) * (c[g] + 0.5) / total + langid.NOISE / langid.GRAMS) for g in grams(t))
        if max(like.values()) > len(grams(t)) * math.log(1 / langid.GRAMS):
            kept.add(i)
    return kept


def brute_copies(rows):
    sets = {i: weights(t) for i, t, *_ in rows}
    comp = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if brute_jp(sets[a], sets[b]) >= 0.8]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i for i, c in comp.items() if i == c}


def brute_clean(rows, items):
    """Ids of texts in which no 13 words, nor the words of an item with one letter changed, occur."""

    def near(a, b):
        return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 2

    kept = set()
    for i, t, *_ in rows:
        text = " ".join(t.lower().split())
        hit = any(near(p, text[k : k + len(p)]) for _, item in items for p in [" ".join(item.lower().split())] for k in range(len(text) - len(p) + 1))
        if not hit:
            kept.add(i)
    return kept


def stored_tables(spark, folder, rows, labels, items):
    docs = [(i, t, lang, s, len(t)) for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_against_a_brute_force_chain(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, labels, items = corpus()
    stored_tables(spark, str(tmp_path), rows, labels, items)
    left = list(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = {"quality": lambda x: brute_quality(x, labels), "language": brute_language, "near_duplicates": brute_copies, "decontamination": lambda x: brute_clean(x, items)}
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = steps[name](left)
        got = {r.doc_id for r in out.select("doc_id").collect()}
        assert got == kept, (name, got ^ kept)
        gone[name] = {r[0] for r in left} - kept
        left = [r for r in left if r[0] in kept]
        docs = spark.createDataFrame([tuple(r) for r in out.collect()], docs.schema)
    assert all(gone.values()), gone  # every stage decides something here
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding(), t.no_truncation()
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x, *_ in left}
    got = {r.doc_id: (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), x) for i, x in want.items()}


def test_stages_on_odd_tables(spark, tmp_path):
    rows, labels, items = corpus()
    stored_tables(spark, str(tmp_path), rows, labels, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("label", F.lit("x")).withColumn("band", F.lit(1)).withColumn("_gone", F.lit(2))
    odd = spark.createDataFrame([(None, rows[1][1], "aa", "s0", 1), (500, None, None, None, None), (501, "", "bb", "s1", 0), (1, rows[1][1], None, "s0", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = docs.unionByName(odd, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        out = stage(spark, mixed, str(tmp_path))
        assert name == "tokens" or out.columns == mixed.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "near_duplicates":
            assert ids.count(1) == 1 and None in ids and 500 in ids and 501 in ids
        if name in ("decontamination", "tokens"):
            assert ids.count(1) == 2 and None in ids and 500 in ids and 501 in ids


def test_fusion_by_plain_sums(spark):
    """Posteriors of the fused evidence against the formula, with every sum written out."""
    r = random.Random(6)
    langs = ["aa", "bb", langid.UNKNOWN]
    rows = []
    for i in range(60):
        like = tuple(round(r.uniform(-8, 0), 3) for _ in langs)
        host = r.choice(["x.a.com", "y.a.com", "b.org", None])
        rows.append((i, r.choice(["aa", "bb", "zz", None]), None if host is None else host.split(".")[-1], host, None if host is None else ".".join(host.split(".")[-2:]), like))
    rows.append((60, "aa", "com", "x.a.com", "a.com", (-1.0, -1.0, -1.0)))  # a tie goes to the first language
    df = spark.createDataFrame([(*x[:5], list(x[5])) for x in rows], "row long, declared string, suffix string, host string, domain string, text_like array<double>")
    got = {x.row: x for x in langid.fused(df, langs).collect()}
    first = {x[0]: max(range(3), key=lambda k: (x[5][k], -k)) for x in rows}
    n, per = len(langs), [sum(first[x[0]] == k for x in rows) for k in range(3)]
    ground = [(p + langid.SMOOTH) / (sum(per) + langid.SMOOTH * n) for p in per]
    count = lambda at, value, k: sum(x[at] == value and first[x[0]] == k for x in rows)
    width = len({x[2] for x in rows if x[2]}) + 1
    for x in rows:
        score = []
        for k in range(3):
            z = x[5][k]
            if x[1] in ("aa", "bb"):
                z += math.log((count(1, x[1], k) + langid.SMOOTH) / (per[k] + langid.SMOOTH * n))
            if x[2]:
                z += math.log((count(2, x[2], k) + langid.SMOOTH) / (per[k] + langid.SMOOTH * width))
            if x[3]:
                nd, nh = (sum(count(at, x[at], j) for j in range(3)) for at in (4, 3))
                p = (count(4, x[4], k) + langid.LEAN * ground[k]) / (nd + langid.LEAN)
                z += math.log((count(3, x[3], k) + langid.LEAN * p) / (nh + langid.LEAN))
            else:
                z += math.log(ground[k])
            score.append(z)
        best = max(range(3), key=lambda k: (score[k], -k))
        assert (got[x[0]].lang, got[x[0]].text_lang) == (langs[best], langs[first[x[0]]])
        assert math.isclose(got[x[0]].posterior, 1 / sum(math.exp(s - score[best]) for s in score), rel_tol=1e-9)


def test_likelihoods_by_plain_counts(spark):
    rows, *_ = corpus()
    df = spark.createDataFrame([(t, lang) for _, t, lang, _ in rows], "text string, lang string")
    langs, table = langid.fit(df)
    counts = defaultdict(Counter)
    for _, t, lang, _ in rows:
        if lang:
            counts[lang].update(langid.grams([t])[0].tolist())
    texts = [rows[0][1], "abc", "", None, rows[1][1] * 20]
    got = langid.likelihoods(texts, table, False)
    for text, like in zip(texts, got):
        g = langid.grams([text])[0].tolist()
        for k, lang in enumerate(langs[:-1]):
            total = sum(counts[lang].values()) + 0.5 * langid.GRAMS
            want = sum(math.log((1 - langid.NOISE) * (counts[lang][x] + 0.5) / total + langid.NOISE / langid.GRAMS) for x in g) / langid.GRAM
            assert math.isclose(like[k], want, rel_tol=1e-5, abs_tol=1e-4)


def test_held_out_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    model = langid.fit(d.where(~held))
    out = langid.identified(langid.document_rows(d.where(held)), model, False).toPandas().set_index("row")
    truth = d.where(held).select("doc_id", "lang").toPandas().drop_duplicates("doc_id").set_index("doc_id")
    both = pd.concat([out.lang.rename("got"), truth.lang.rename("want")], axis=1).dropna()
    assert len(both) > 200 and (both.got == both.want).mean() > 0.9
