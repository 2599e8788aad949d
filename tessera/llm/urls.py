"""URL filter: listed rules first, else the empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted per host. Beta-binomial shrinkage goes from the corpus to the
suffix, from there to the registered domain and to the host; the strength of each step is the moment estimate of how much its
rates differ. A page is blocked where the host's posterior bad rate lies above LIMIT by its lower bound.
All steps are DataFrame operations; pages are joined by host with one row per host.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hosts import domain_of, suffix_of

#: Blocked from this bad rate on, by a lower bound of DEVIATIONS posterior standard deviations.
LIMIT, DEVIATIONS = 0.3, 1.645
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The digest of the empty string.
NOTHING = hashlib.sha256(b"").hexdigest()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Beta-binomial concentration of the groups' (n, bad) around ``mean``, by moments, within 0.1 and 10,000."""
    spread = mean * (1 - mean)
    rate = F.col("bad") / F.col("n")
    top = F.sum(F.col("n") * (rate - mean) ** 2 - spread)
    r = groups.where("n > 0").agg(top.alias("over"), F.sum(spread * (F.col("n") - 1)).alias("room")).first()
    rho = r.over / r.room if r.room and r.over is not None else 1.0
    rho = min(1 / 1.1, max(1 / 10_001, rho))
    return 1 / rho - 1


def reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, mean, bound (lower bound of the bad rate), n for each row of ``hosts`` (host, distinct).

    ``outcomes`` has url and bad (0 or 1); other values and nulls are left out. Hosts without an outcome have their domain's rate.
    """
    own = outcomes.where(F.col("bad").isin(0, 1)).select(host_of(F.col("url")).alias("host"), "bad")
    seen = own.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    every = hosts.join(seen, "host", "left").select(
        "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")
    )
    total = every.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    ground = ((total.bad or 0) + 0.5) / ((total.n or 0) + 1.0)
    sums = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    level = sums(every, "suffix")
    m = _strength(level, F.lit(ground))
    suffixes = level.select("suffix", ((F.col("bad") + m * ground) / (F.col("n") + m)).alias("suffix_mean"))
    level = sums(every, "suffix", "domain").join(suffixes, "suffix")
    m = _strength(level, F.col("suffix_mean"))
    domains = level.select("domain", ((F.col("bad") + m * F.col("suffix_mean")) / (F.col("n") + m)).alias("domain_mean"))
    level = every.join(domains, "domain")
    m = _strength(level, F.col("domain_mean"))
    a, size = F.col("bad") + m * F.col("domain_mean"), F.col("n") + m
    mean = a / size
    deviation = F.sqrt(mean * (1 - mean) / (size + 1))
    return level.select("host", mean.alias("mean"), F.greatest(F.lit(0.0), mean - DEVIATIONS * deviation).alias("bound"), "n")


def host_rules(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host and its fitting rules (path, rule, verdict): an equi-join over the host and its parents."""
    listed = hosts.sparkSession.createDataFrame([(h, p, h + p, v) for v, h, p in rules], "parent string, path string, rule string, verdict string")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(parents).alias("parent")).join(listed, "parent")
    return fits.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "path", "rule", "verdict")).alias("rules"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bound for every row of ``pages`` (page_id, url; more may be there).

    The longest rule that fits decides; of equally long ones, the one of the longest path. Otherwise the reputation does.
    Null urls and urls without :// have an empty host and path, and the reputation of the empty host.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("url_path"))
    hosts = own.select("host").distinct()
    known = reputation(outcomes, hosts).join(host_rules(hosts, rules), "host", "left")
    fitting = F.filter("rules", lambda r: F.col("url_path").startswith(r["path"]))
    row = own.join(known, "host").withColumn("best", F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("size"), F.length(r["path"]).alias("long"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))))
    verdict = F.coalesce("best.verdict", F.when(F.col("bound") > LIMIT, "block").otherwise("allow"))
    return row.select("page_id", "host", F.col("url_path").alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.col("mean").alias("bad_rate"), "bound")


def _squeezed(text: Column) -> Column:
    """A digest of the text without white space, null where nothing is left."""
    return F.nullif(F.sha2(F.regexp_replace(text, r"\s+", ""), 256), F.lit(NOTHING))


def labelled_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad of the pages whose article is the text of a labelled document: bad is low quality or toxic.

    Articles and texts are compared without white space; a text with several labels is bad if one of them says so. Blank
    texts, blank articles and pages without one say nothing.
    """
    marked = labels.where("doc_id is not null").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")).where("bad is not null")
    texts = docs.select("doc_id", _squeezed(F.col("text")).alias("digest")).where("digest is not null")
    texts = texts.join(marked, "doc_id").groupBy("digest").agg(F.max("bad").alias("bad"))
    article = F.regexp_extract("html", r"(?s)<article[^>]*>(.*?)</article>", 1)
    plain = F.regexp_replace(F.regexp_replace(article, r"(?s)<h1[^>]*>.*?</h1>", ""), r"<[^>]*>", "")
    for code, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(mark))
    own = pages.select("url", _squeezed(plain).alias("digest")).where("digest is not null")
    return own.join(texts, "digest").select("url", "bad")
