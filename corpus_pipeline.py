"""The corpus pipeline: quality, language, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, minhash, quality
from tessera.llm.common import stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Pieces a worker remembers: fewer than alone, as the stages before leave the executors with large heaps.
REMEMBERED = 150_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by the labels that may teach, gives 0.5 or more."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus."""
    return langid.recognised(docs, langid.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each document."""
    ids = bpe.encoded(docs, TOKENIZER, remembered=REMEMBERED)
    return ids.select("doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), "ids")


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", free_of_benchmarks),
    ("tokens", tokens),
]

#: The stages' models, similarities and encodings have no SQL form; tests/llm/test_pipeline.py holds the chain against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
