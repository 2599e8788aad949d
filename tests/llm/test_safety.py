"""Ids beyond doubles, null ids, inner column names, both sides of the broadcast limit, repeated and missing rows."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import docs, labelled, prose

from tessera.llm import bpe, common, decontam, langid, learn, licenses, minhash, quality, toxicity, urls, warc

BIG = 2**53 + 1
CLASH = ("_gone", "_bit", "_word", "_bits", "_doubt", "_twice", "_in", "gone", "bit", "word", "mask", "doubt", "twice", "flag", "row", "lang", "host", "fold", "copy", "bands", "hub", "unit", "n", "text_like")


def clashing(df):
    for i, name in enumerate(CLASH):
        df = df.withColumn(name, F.lit(i)) if name not in df.columns else df
    return df


def with_ids(spark, texts, ids):
    return spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1)


def test_large_and_null_ids_come_back_as_they_are(spark):
    ids = [BIG, None, BIG + 2, None, -(2**62) - 1]
    notice = "Released under the MIT License."
    passage = prose(7, 30)
    d = with_ids(spark, [prose(1) + " " + passage + "\n" + notice] * 3 + [None, passage + "\n" + notice], ids)
    same = lambda df: sorted(map(str, (r.doc_id for r in df.select("doc_id").collect())))
    want = sorted(map(str, ids))
    base, labels, _ = labelled(spark, 60)
    q = quality.judged(d, quality.fit(base, labels), 3, 1)
    t = toxicity.scored(d, toxicity.fit(base, labels), 5, 0)
    assert same(q) == same(t) == want
    held = {r.doc_id: (r.held_out, s.held_out) for r, s in zip(q.where("doc_id is not null").orderBy("doc_id").collect(), t.where("doc_id is not null").orderBy("doc_id").collect())}
    assert held == {i: (zlib.crc32(str(i).encode()) % 3 == 1, zlib.crc32(str(i).encode()) % 5 == 0) for i in ids if i is not None}
    assert same(bpe.encoded(d, public_tokenizers.path("word_bpe_49k.json"), digests=True)) == want
    few = sorted(map(str, [BIG, None, BIG + 2, -(2**62) - 1]))
    bench = spark.createDataFrame([(BIG + 4, passage)], "item_id long, text string")
    found = decontam.contaminated(d, bench)
    assert same(found) == few and {r.item_id for r in found.collect()} == {BIG + 4}
    assert same(licenses.license_matches(d)) == few
    rows = langid.document_rows(d.withColumn("source", F.lit("s")))
    out = langid.identified(rows, langid.fit(base), False)
    assert sorted(map(str, (r.row for r in out.collect()))) == want


def test_archives_keep_large_ids(spark, tmp_path):
    pages = spark.createDataFrame([(BIG, "u", "same"), (BIG - 1, "u", "same"), (None, None, "same"), (BIG + 2, "u", None)], "page_id long, url string, html string").coalesce(1)
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / "w"))).collect()}
    assert got == {(BIG, "response", None), (BIG - 1, "revisit", BIG), (None, "revisit", BIG), (BIG + 2, "response", None)}


@pytest.mark.parametrize("limit", [0, 500_000])
def test_without_keeps_columns_of_any_name(spark, monkeypatch, limit):
    monkeypatch.setattr(learn, "MOST_BROADCAST", limit)
    d = clashing(with_ids(spark, ["a"] * 6, [1, 2, 3, 3, BIG, None]))
    left = learn.without(d, "doc_id", spark.createDataFrame([(3,), (BIG,), (77,)], "x long"))
    assert left.columns == d.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == ["1", "2", "None"]
    assert all([r[n] for n in CLASH] == list(range(len(CLASH))) for r in left.collect())
    assert {1, 3} <= {r.doc_id for r in learn.among(d, "doc_id", spark.createDataFrame([(3,), (1,)], "x long")).collect()}
    assert learn.without(d.where("false"), "doc_id", spark.createDataFrame([(3,)], "x long")).count() == 0


@pytest.mark.parametrize("limit", [0, 500_000])
def test_labelled_rows_on_both_sides_of_the_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(learn, "MOST_BROADCAST", limit)
    d, labels, n = labelled(spark, 90)
    train = learn.training(labels, "quality", 3, 1)
    got = sorted((r.text, r.label) for r in learn.labelled(d, train).collect())
    want = sorted((r.text, 1 - r.doc_id % 2) for r in d.where(f"doc_id < {n}").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    assert got == want


def test_one_text_teaches_for_a_repeated_id(spark):
    d, labels, _ = labelled(spark, 60)
    many = d.unionByName(d.withColumn("text", F.concat("text", F.lit(" again")))).unionByName(d)
    train = learn.training(labels, "quality", 3, 1)
    assert learn.sampled(many, train, 20).count() in (19, 20)  # one label has no document
    assert learn.sampled(many, train, 1000).count() == train.join(d, "doc_id").count()
    a, b = (sorted(map(str, learn.sampled(x, train, 30).collect())) for x in (many, many.repartition(5)))
    assert a == b


def test_stages_take_repeated_rows_and_any_column_name(spark, monkeypatch):
    monkeypatch.setattr(learn, "MOST_BROADCAST", 1)
    base, labels, n = labelled(spark, 60)
    d = clashing(base.unionByName(base).unionByName(base.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert quality.accepted(d, quality.fit(d, labels)).columns == d.columns
    kept = minhash.keep_one(d)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == d.columns and len(ids) == len(set(ids)) and None in ids
    assert langid.recognised(d, langid.fit(base)).columns == d.columns
    clean = decontam.clean(d, spark.createDataFrame([(1, prose(7777, 40))], "item_id long, text string"))
    assert clean.columns == d.columns and clean.count() == d.count()
    model = quality.fit(base, labels)
    assert quality.scored(base.unionByName(base), model).count() == 2 * base.count()
    assert toxicity.scored(base.unionByName(base), toxicity.fit(base, labels), 5, 0).count() == 2 * base.count()
    assert decontam.contaminated(base.unionByName(base), spark.createDataFrame([(1, prose(5, 30)), (2, prose(5, 30))], "item_id long, text string")).count() == 0


def test_several_blocks_and_a_repeated_line(spark, monkeypatch):
    line = prose(42, 16)
    items = {1: prose(100, 40), 2: prose(101, 40), 3: line, 4: line, 5: "\n".join([line] * 3000), 6: "tiny", 7: prose(102, 40) + " " + line}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    texts = {0: prose(1, 50), 1: prose(2) + " " + items[1], 2: items[2] + " " + prose(3), 3: prose(4) + "\n" + "\n".join([line] * 2000), 4: "a tiny one", 5: None, 6: "", 7: prose(102, 40)}
    d = docs(spark, texts)
    whole = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, bench).select("doc_id", "item_id").distinct().collect()}
    assert whole == {(1, 1), (2, 2), (3, 3), (3, 5), (3, 7), (4, 6), (7, 7)}  # 4 is the same text as 3
    for name, value in (("BLOCK_BYTES", 300), ("MOST_ENTRIES", 2_000)):
        monkeypatch.setattr(decontam, name, value)
        parts = decontam.contaminated(d, bench)
        assert {(r.doc_id, r.item_id) for r in parts.select("doc_id", "item_id").distinct().collect()} == whole
        assert {r.doc_id for r in decontam.clean(d, bench).collect()} == {0, 5, 6}
    no_short = bench.where("item_id <> 6")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, no_short).select("doc_id", "item_id").distinct().collect()} == whole - {(4, 6)}


def test_the_first_look_loses_no_passage():
    import random

    import numpy as np

    r, items = random.Random(4), [prose(200 + i, 30) for i in range(20)]
    bits = next(decontam._bits(iter([__import__("pandas").DataFrame({"text": items})]), 16))
    look = object.__new__(decontam.Bitmap)
    look.bits, look.least = 16, int(bits["mask"][bits.word < 0].iloc[0])
    packed = np.zeros(1 << 10, np.int64)
    packed[bits.word[bits.word >= 0]] = bits["mask"][bits.word >= 0]
    look.packed = type("Held", (), {"value": packed})()
    windows = decontam.Windows(list(enumerate(items)))
    texts = [prose(900, 20)]
    for _ in range(100):
        w = r.randrange(len(windows.text))
        s = bytearray(windows.text[w])
        for _ in range(int(windows.edits[w])):
            s[r.randrange(len(s))] = ord("z")
        texts.append(prose(r.randrange(10**6), 20) + " " + s.decode() + " " + prose(r.randrange(10**6), 20))
    found = np.array([bool(x) for x in decontam.passages(texts, windows)])
    assert found.sum() > 90 and not (found & ~look.suspects(texts)).any()


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    from tessera.sources import scratch

    class Conf:
        def __init__(self, path):
            self.path = path

        def get(self, key, default=None):
            return self.path or default

    class Session:
        def __init__(self, path):
            self.conf, self.sparkContext = Conf(path), type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session(None))
    assert scratch.shared_dir(Session("s3://b/c/")) == "s3://b/c"


def test_batches_are_bounded_by_bytes_alone(spark):
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    common.session(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows
    long = spark.range(0, 64, 1, 1).select("id", F.repeat(F.lit("x"), 200_000).alias("text"))
    sizes = [r.n for r in common.beside(long, lambda lists: ((range(len(t)), {"n": [len(t)] * len(t)}) for t in lists), "n long").collect()]
    assert len(sizes) == 64 and max(sizes) <= 8


def test_blank_articles_say_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.co.uk/", "<p>no article</p>"), (2, "http://a.co.uk/", "<article> \n</article>"), (3, "http://b.com/", "<article>Real words</article>"), (4, None, None)], "page_id long, url string, html string")
    d = spark.createDataFrame([(1, ""), (2, " \n"), (3, "Real\nwords"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert [(r.url, r.bad) for r in urls.labelled_outcomes(pages, d, labels).collect()] == [("http://b.com/", 1)]
    h = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.com",), ("com",), ("",)], "h string")
    got = {r.h: (r.d, r.s) for r in h.select("h", urls.domain_of(F.col("h")).alias("d"), urls.suffix_of(F.col("h")).alias("s")).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com": ("y.com", "com"), "com": ("com", "com"), "": ("", "")}
