"""Language identification by Bayesian fusion of text, markup, address and host evidence.

Text: byte GRAM-gram shares per language, learnt from labelled texts, with a uniform class "und" for
what is no language at hand; overlapping grams are not independent, so a text counts as its length
over GRAM grams. Over the first, text-only answers of all rows, grouped aggregation
gives P(declared | language), P(suffix | language) and P(language | host), the last shrunk from host
to registered domain to the whole corpus. The posterior multiplies them.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, frugal, session, stored
from .hosts import domain_of, suffix_of
from .learn import without
from .words import U, chunks

GRAM, GRAMS = 4, 1 << 16
UNKNOWN = "und"
#: Pseudo-counts by which a host leans on its domain and a domain on the corpus; smoothing of the tables.
LEAN, SMOOTH = 20.0, 1.0
#: Share of a language's texts (numbers, keys, names) that may be any bytes.
NOISE = 0.2
_UNSEEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def visible(page: str | None) -> str:
    """The text of an HTML page: tags, comments, scripts and styles give way to blanks."""
    return markup.unescape(_UNSEEN.sub(" ", page)) if page else ""


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte grams of all texts one after another, and each text's offsets among them."""
    parts = [" ".join(t.lower().split()).encode("utf-8", "replace") if t else b"" for t in texts]
    counts = np.array([max(0, len(p) - GRAM + 1) for p in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    data = (b"\0" * (GRAM - 1)).join(parts) + b"\0" * GRAM
    code = np.ndarray(max(0, len(data) - GRAM + 1), "<u4", data, 0, (1,))
    starts = np.concatenate([[0], np.cumsum([len(p) + GRAM - 1 for p in parts])])[:-1]
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], counts)
    return ((code[at].astype(U) * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.int64), offsets


@frugal
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, rows in b.groupby("lang"):
            texts = rows.text.tolist()
            for lo, hi in chunks(texts):
                g, _ = grams(texts[lo:hi])
                total[lang] = total.get(lang, 0) + np.bincount(g, minlength=GRAMS)
    for lang, n in total.items():
        g = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "gram": g, "n": n[g]})


def fit(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log shares (languages x GRAMS, the last row uniform) learnt from all of ``texts`` (text, lang).

    Rows without a language or text teach nothing. Without any labelled row, "und" is the only answer.
    """
    session(texts.sparkSession)
    own = texts.select(F.col("text"), F.lower("lang").alias("lang")).where("text is not null and lang is not null and lang <> ''")
    rows = own.mapInPandas(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows.lang.unique())
    table = np.full((len(langs) + 1, GRAMS), 0.5)
    for i, lang in enumerate(langs):
        part = rows[rows.lang == lang]
        table[i, part.gram.to_numpy()] += part.n.to_numpy()
    table[-1] = 1.0
    share = (1 - NOISE) * table / table.sum(axis=1, keepdims=True) + NOISE / GRAMS
    return [*langs, UNKNOWN], np.log(share).astype(np.float32)


def likelihoods(texts: list, table: np.ndarray, pages: bool) -> np.ndarray:
    """Log likelihood of each text (rows) in each language (columns)."""
    out = []
    for lo, hi in chunks(texts):
        g, offsets = grams([visible(t) for t in texts[lo:hi]] if pages else texts[lo:hi])
        sums = np.zeros((hi - lo, len(table)))
        full = np.diff(offsets) > 0
        if full.any():
            for k, row in enumerate(table):
                sums[full, k] = np.add.reduceat(row[g].astype(np.float64), offsets[:-1][full]) / GRAM
        out.append(sums)
    return np.concatenate(out) if out else np.empty((0, len(table)))


def text_evidence(rows: DataFrame, model: tuple, pages: bool) -> DataFrame:
    """``rows`` (row, text, declared, suffix, host, domain) with text_like, one log likelihood a language, for text."""
    table = model[1]

    def work(lists):
        for texts in lists:
            yield range(len(texts)), {"text_like": list(likelihoods(texts, table, pages))}

    return beside(rows, work, "text_like array<double>")


def fused(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """lang, posterior and text_lang added to the rows of text_evidence. Ties go to the first language.

    Missing declarations, suffixes and hosts are no evidence. Only declared languages that are known count.
    """
    n = len(langs)
    like = [F.col("text_like")[i] for i in range(n)]

    def best(values: list[Column]) -> Column:
        top = F.greatest(*values) if n > 1 else values[0]
        return F.coalesce(*[F.when(v >= top, F.lit(i)) for i, v in enumerate(values)], F.lit(n - 1))

    declared = F.when(F.col("declared").isin(langs[:-1]), F.col("declared"))
    rows = evidence.withColumn("declared", declared).withColumn("first", best(like))
    rows = stored(rows, "text_evidence")
    counts = lambda *by: rows.groupBy(*by).agg(*[F.sum((F.col("first") == i).cast("double")).alias(f"n{i}") for i in range(n)])
    total = counts(F.lit(1).alias("one")).first()
    per = [float(total[f"n{i}"]) if total else 0.0 for i in range(n)]
    every = sum(per) + SMOOTH * n
    ground = [(p + SMOOTH) / every for p in per]

    def table(by: str, width: int, name: str) -> DataFrame:
        c = counts(by).where(F.col(by).isNotNull())
        return c.select(by, *[F.log((F.col(f"n{i}") + SMOOTH) / F.lit(per[i] + SMOOTH * width)).alias(f"{name}{i}") for i in range(n)])

    width = rows.where("suffix is not null").groupBy("suffix").count().count() + 1
    d, s = table("declared", n, "d"), table("suffix", width, "s")
    domains = counts("domain").where("domain is not null")
    size = sum((F.col(f"n{i}") for i in range(1, n)), F.col("n0"))
    domains = domains.select("domain", *[((F.col(f"n{i}") + LEAN * ground[i]) / (size + LEAN)).alias(f"p{i}") for i in range(n)])
    hosts = counts("host", "domain").where("host is not null").join(domains, "domain")
    hosts = hosts.select("host", *[F.log((F.col(f"n{i}") + LEAN * F.col(f"p{i}")) / (size + LEAN)).alias(f"h{i}") for i in range(n)])
    whole = rows.join(F.broadcast(d), "declared", "left").join(s, "suffix", "left").join(hosts, "host", "left")
    score = [like[i] + F.coalesce(F.col(f"d{i}"), F.lit(0.0)) + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.coalesce(F.col(f"h{i}"), F.lit(float(np.log(ground[i])))) for i in range(n)]
    whole = whole.select(*rows.columns, *[x.alias(f"z{i}") for i, x in enumerate(score)])
    z = [F.col(f"z{i}") for i in range(n)]
    names = F.array(*[F.lit(x) for x in langs])
    top = F.greatest(*z) if n > 1 else z[0]
    mass = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    pick = best(z) if n > 1 else F.lit(0)
    return whole.select(*rows.columns, names[pick].alias("lang"), (1 / mass).alias("posterior"), names[F.col("first")].alias("text_lang"))


def page_rows(pages: DataFrame) -> DataFrame:
    """The evidence columns of web pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1))
    lang = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    own = pages.select(F.col("page_id").alias("row"), F.col("html").alias("text"), F.when(lang != "", lang).alias("declared"), F.when(host != "", host).alias("host"))
    return own.select("row", "text", "declared", suffix_of(F.col("host")).alias("suffix"), "host", domain_of(F.col("host")).alias("domain"))


def document_rows(docs: DataFrame) -> DataFrame:
    """The evidence columns of documents (doc_id, text, source): the source is the host; nothing is declared."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("row"), "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"), F.col("source").alias("domain"))


def identified(rows: DataFrame, model: tuple, pages: bool) -> DataFrame:
    """row, lang, posterior, text_lang for each row. Null and empty texts leave it to the other evidence."""
    session(rows.sparkSession)
    return fused(text_evidence(rows, model, pages), model[0]).select("row", "lang", "posterior", "text_lang")


def recognised(docs: DataFrame, model: tuple, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a posterior of ``least`` or more.

    Rows of a null id stay, as nothing can name them; rows that share an id go together.
    """
    found = identified(document_rows(docs), model, False)
    gone = stored(found.where((F.col("lang") == UNKNOWN) | (F.col("posterior") < least)).where("row is not null").select("row").distinct(), "gone")
    return without(docs, "doc_id", gone)
