"""The corpus pipeline: each stage applies one operator to what the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm import byte_bpe, line_dedup, mixing, near_duplicates, toxicity
from cohortline.session import configure, cut_lineage
from cohortline.sources.io import load


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores below 0.5."""
    configure(spark)
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that are equal or one word apart from an earlier line."""
    configure(spark)
    kept = line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    configure(spark)
    return near_duplicates.keep_first_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    configure(spark)
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's number of ids and the digests of the ids and of the bytes decoded from them."""
    configure(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]

# A learned grammar and its score cannot be said in SQL; a test compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
