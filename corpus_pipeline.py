"""Corpus pipeline: stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads again as the next one's docs.
All stages but the last return the columns of ``documents``.

What each does with odd rows is said in its operator's module; in short: null
texts are empty, nothing fails on nulls, empty tables or further columns, and
rows without doc_id are scored, mixed and packed but have no duplicates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shopsignals.llm import entropy_mixing, mil_quality, minhash_forest, packing, rlz_dedup
from shopsignals.llm.tables import read, store


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier predicts to be of quality label 1."""
    return mil_quality.accepted(docs, mil_quality.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each near-duplicate group."""
    return minhash_forest.keep_one(docs, 0.8)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words of repeated 35-word windows from every text."""
    return rlz_dedup.remove_duplicate_spans(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents until sources hold their target words."""
    return entropy_mixing.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of at most 4096."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", classify_quality), ("n-gram Jaccard join", drop_near_duplicates),
          ("substring dedup", dedup_substrings), ("mixing sources to target weights", mix_sources), ("packing", pack_sequences)]

# A learned score, groups of links, hash-dealt copies and tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the given documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
