"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenql.llm import decontaminate, kneser_ney, packing, paragraph_dedup
from lumenql.llm.common import shared_folder, table
from lumenql.llm.queries import vocabulary

#: Words that a worker remembers in packing: executors have run four stages before it and hold their heap.
CACHE_WORDS = 250_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the language model of trusted text rejects go."""
    return kneser_ney.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (SimHash classes and bands, five-word shingles 0.8 alike) stays, that of the smallest doc_id."""
    return paragraph_dedup.deduplicate(docs.select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; documents of which nothing is left go."""
    out = paragraph_dedup.substring_dedup(docs.select(*COLUMNS))
    return out.where(r"n_removed_spans = 0 or text rlike '\\S'").select(*COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly such go."""
    return decontaminate.remove_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"), vocabulary(), cache_words=CACHE_WORDS, forget=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", passages), ("decontamination", benchmarks), ("packing", packed)]

#: Scoring, near copies and byte-pair encoding can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet in the shared folder and read again."""
    folder = shared_folder(spark)
    base = os.path.join(folder, f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
