"""The registered queries of the corpus operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, langid, licenses, periods, quality, suffix_tree, toxicity, urls, warc
from .common import forgotten, scratch_path, stored, table
from .hosts import SUFFIXES
from .metric_join import near_vectors
from .minhash import near_duplicates


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")), 3, 1)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    files = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    forgotten(spark, folder)
    read = warc.read_archives(spark, files, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    pages = langid.identified(langid.page_rows(table(spark, sf_dir, "pages")), model, True)
    texts = langid.identified(langid.document_rows(docs), model, False)
    none = F.lit(None).cast("long")
    return pages.select(F.col("row").alias("page_id"), none.alias("doc_id"), "lang", "posterior", "text_lang").unionByName(
        texts.select(none.alias("page_id"), F.col("row").alias("doc_id"), "lang", "posterior", "text_lang")
    )


def op5_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), 5, 0)


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = urls.labelled_outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    judged = urls.judged(pages, stored(outcomes, "outcomes"))
    return judged.withColumn("bad_rate", F.round("bad_rate", 6)).withColumn("bound", F.round("bound", 6))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(periods.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = suffix_tree.fit(suffix_tree.teaching(docs, 5, 1))
    scored = suffix_tree.scored(docs, model)
    return scored.select("doc_id", suffix_tree.held_out(5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality_nbsvm, op2_decontamination, op3_warc, op4_language_id, op5_metric_range_join, op6_minhash_near_dedup, op7_license_scan, op8_bpe, op9_toxic_segments, op10_url_reputation, op11_periodic_runs, op12_source_divergence, op13_suffix_tree_lm)
    return {f.__name__: f for f in every}


_B32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_DIGEST = f"""array_to_string(list_transform(range(0, 32), lambda i: substr({_B32}, ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '')"""
_SQUEEZED = "sha256(nullif(regexp_replace({}, '[ \\t\\n\\x0b\\f\\r]+', '', 'g'), ''))"
_ARTICLE = "regexp_replace(regexp_replace(regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's'), '<h1[^>]*>.*?</h1>', '', 'gs'), '<[^>]*>', '', 'g')"
for _code, _mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _ARTICLE = f"replace({_ARTICLE}, '{_code}', '{_mark}')"


def _strength(rows: str, mean: str) -> str:
    """The moment estimate of a level's concentration as a scalar subquery."""
    over, room = f"sum(n * pow(bad / n - {mean}, 2) - {mean} * (1 - {mean}))", f"sum({mean} * (1 - {mean}) * (n - 1))"
    return f"(select 1 / least(1 / 1.1, greatest(1.0 / 10001, case when {room} <> 0 then {over} / {room} else 1.0 end)) - 1 from {rows} where n > 0)"


def _labels(wide: int, plain: int) -> str:
    """The last labels of a host: ``wide`` of them under a suffix of two labels, else ``plain``."""
    last = lambda n: f"regexp_extract(p.host, '([^.]*\\.){{0,{n - 1}}}[^.]*$', 0, 's')"
    return f"case when {last(2)} in ({', '.join(repr(x) for x in SUFFIXES)}) then {last(wide)} else {last(plain)} end"


_REPUTATION = f"""
    texts as (select {_SQUEEZED.format("text")} as digest, max((quality = 0 or toxic = 1)::int) as bad from documents join labels using (doc_id) where quality is not null or toxic is not null group by 1),
    outcomes as (select url, bad from pages join texts on digest = {_SQUEEZED.format(_ARTICLE)} where bad is not null),
    page as (select page_id, coalesce(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')), '') as host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
    seen as (select lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')) as host, count(*) as n, sum(bad) as bad from outcomes group by 1),
    host as (select p.host, {_labels(3, 2)} as domain, {_labels(2, 1)} as suffix, coalesce(n, 0)::double as n, coalesce(bad, 0)::double as bad from (select distinct host from page) p left join seen s on p.host = s.host),
    ground as (select (sum(bad) + 0.5) / (sum(n) + 1) as g from host), s0 as (select suffix, sum(n) as n, sum(bad) as bad, any_value(g) as g from host, ground group by suffix),
    s1 as (select suffix, (bad + m * g) / (n + m) as sm from s0, (select {_strength("s0", "g")} as m) t),
    d0 as (select host.suffix, domain, sum(n) as n, sum(bad) as bad, any_value(sm) as sm from host join s1 on host.suffix = s1.suffix group by 1, 2), d1 as (select domain, (bad + m * sm) / (n + m) as dm from d0, (select {_strength("d0", "sm")} as m) t),
    h0 as (select host, n, bad, dm from host join d1 on host.domain = d1.domain), h1 as (select host, (bad + m * dm) / (n + m) as mean, n + m as size from h0, (select {_strength("h0", "dm")} as m) t),
    rep as (select host, mean, greatest(0.0, mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1))) as bound from h1),
    rules as (select * from (values ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) t(rh, rp, rule, verdict)),
    best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from page join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)"""


_DIVERGENCE = r"""
    d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
    t as (select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
    kept as (select lang, term, count(*) as c from t group by 1, 2 having count(distinct r) >= 3),
    k as (select lang, term, c, sum(c) over (partition by lang) as n, count(*) over (partition by lang) as v from kept),
    g as (select distinct lang, source from d), c as (select lang, source, term, count(*) as c from t group by 1, 2, 3),
    f as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + 1000000000::hugeint * (k.c + 1) // (k.n + k.v) as ql, k.v, sum(coalesce(c.c, 0)) over (partition by g.lang, g.source) as n
        from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    p as (select lang, source, term, c, ql, 1 + 1000000000::hugeint * (c + 1) // (n + v) as p from f),
    pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
    every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
        union all select lang, source, 'term', term, (p - ql) * (p - ql) // ql from p where c > 0 and p > ql)
    select lang, source, part, item, value::bigint as value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every qualify part = 'pair' or rank <= 200"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can state; the others are tested against brute force."""
    return {
        "op12_source_divergence": f"with {_DIVERGENCE}",
        "op3_warc": f"""with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages), t as (select *, max(page_id) over (partition by h) as top from p)
            select page_id, octet_length(encode(html))::bigint as payload_bytes, {_DIGEST} as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from t""",
        "op5_metric_range_join": """with recursive v as (select vec_id, embedding::double[] as e from embeddings), p as (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
            walk as (select vec_id as id, vec_id as root from embeddings union select p.v, w.root from walk w join p on p.u = w.id), c as (select id, min(root) as component_id from walk group by id), n as (select u, count(*) as n from p group by u)
            select id as vec_id, coalesce(n, 0)::bigint as n_links, component_id, id = component_id as kept from c left join n on u = id""",
        "op10_url_reputation": f"with {_REPUTATION} select page.page_id, page.host, path, rule, coalesce(verdict, case when bound > 0.3 then 'block' else 'allow' end) as verdict, round(mean, 6) as bad_rate, round(bound, 6) as bound from page join rep on page.host = rep.host left join best on page.page_id = best.page_id",
    }
