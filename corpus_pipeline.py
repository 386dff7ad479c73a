"""Documents to training sequences: civil, without near-duplicates, without personal data, mixed, packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.catalog import PII_KEY
from lectern.llm.mixture import repeat_documents
from lectern.llm.near_texts import keep_distinct
from lectern.llm.packing import pack_documents
from lectern.llm.pii import pseudonymize_documents
from lectern.llm.shared import saved, table
from lectern.llm.toxicity import keep_civil


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rated toxic go."""
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard similarity of 0.8) the document with the smallest id stays."""
    return keep_distinct(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms; every document stays."""
    return pseudonymize_documents(docs, PII_KEY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents are repeated, or taken in part, to its target."""
    return repeat_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", civil), ("near_dedup", distinct), ("pii", private), ("mixture", mixed), ("packing", packed)]

#: Learned weights and token ids are beyond SQL; the tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
