"""Corpus pipeline over ``documents``: clean, deduplicate, mix, encode.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``, works on all rows that its predecessor
kept, and is written as Parquet and read again before the next.  All stages but the last return
the columns of ``documents``; rejected documents and copies are gone from them, and the mixture
repeats rows.  Nulls, empty texts, repeated rows and extra columns are handled as the operators'
modules say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, exact, mixing, neardup, quality
from tessella.llm.common import stage, table, whole_text
from tessella.llm.queries import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table."""
    return quality.apply_rules(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact.distinct_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the document with the smallest doc_id."""
    return neardup.drop_near(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source, token count and digests of ids and decoded text of every row of the mixture."""
    rows = docs.select("doc_id", "source", whole_text().alias("text"))
    return bpe.encode(rows, vocabulary_path(), keep=["doc_id", "source"], decoded="decoded").select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe_round_trip", bpe_round_trip),
]

#: Near-duplicates, the mixture's rounding and the ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
