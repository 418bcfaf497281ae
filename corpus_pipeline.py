"""Corpus preparation: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; ``run`` writes each result as Parquet under the shared checkpoint folder
and rereads it.  All stages but the last return the columns of documents as
they came, extra columns included.

Defined results: doc_id is the key of a document, rows that repeat a doc_id
are one document (the exact stage keeps one of them); rows with null doc_id
are never dropped as copies or leaks; null, empty and letterless texts go in
the first stage; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import bpe, decontaminate, exact_dedup, lang_id, ngram_join
from cohortspark.llm.common import saved, without

#: A document whose n-grams fit no learned profile better than this is not text in a known language.
MIN_LANGUAGE_SCORE = 0.25
WORD_BPE = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: und, or a score below MIN_LANGUAGE_SCORE."""
    found = lang_id.identify(docs)
    bad = found.where((F.col("lang_pred") == "und") | (F.col("score") < MIN_LANGUAGE_SCORE))
    textless = docs["text"].isNull() | ~F.rlike(docs["text"], F.lit(r"\p{L}"))
    return without(docs.where(~textless), bad.select("doc_id"), "no-language")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the largest doc_id."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = saved(repeated, "repeated-ids")
    if not repeated.isEmpty():
        again = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        docs = saved(without(docs, repeated, "repeated-ids").unionByName(again.select(*docs.columns)), "one-row-an-id")
    groups = exact_dedup.exact_groups(docs)
    return without(docs, groups.where("not kept").select("doc_id"), "copies")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8 or more)."""
    groups = ngram_join.near_groups(docs, k=5, num=80, den=100)
    return without(docs, groups.where("component_id <> doc_id").select("doc_id"), "near-copies")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage or a paraphrase of one."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, leaks.select("doc_id"), "leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and checksums of the ids and of the decoded text."""
    return bpe.encode_digest(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard", near), ("decontaminate", clean),
          ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
