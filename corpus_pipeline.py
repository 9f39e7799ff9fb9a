"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing, encoding.

Every stage works on all that its predecessor kept and is written as Parquet before
the next one reads it. Reading does not keep the order of several files, so the mixing
stage writes each row's slot and order_key, and the last stage returns them with the
digests: by (slot, order_key, doc_id) they are in the mixture's order.

Defined cases, in any stage and in run(): a null or empty text has no words and goes in the
first stage; null languages and sources are a group and a lane of their own; a null doc_id is
kept like any other, but loses to a numbered one with the same text or the same shingles;
rows that share a doc_id are decided each by their own text, rows equal in doc_id and text
once; of equal texts the largest doc_id stays, of near duplicates the smallest; texts of any
length are read whole; empty tables pass through; columns beyond those of documents stay with
their rows up to the last stage, whatever their names, but for slot and order_key, which the
mixing stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from tallymark.llm.common import staged, unstage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs.drop("slot", "order_key"), with_place=True)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, carried=("slot", "order_key"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL can express neither the schedule nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        unstage(before)
        before.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
