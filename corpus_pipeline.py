"""From raw documents to token ids: the stages, applied one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relrank.llm import byte_bpe
from relrank.llm.common import stored, stored_by_small_batches, table
from relrank.llm.decontamination import drop_leaks
from relrank.llm.exact_dedup import drop_exact_duplicates
from relrank.llm.language_id import keep_identified, learn
from relrank.llm.near_dedup import drop_near_duplicates
from relrank.llm.queries import byte_vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return keep_identified(docs, learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of what they decode to."""
    return stored_by_small_batches(byte_bpe.round_trip(docs, byte_vocabulary(spark)))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", clean),
    ("byte-level BPE", encoded),
]

ORACLE_SQL = None  # language ID and latent retrieval are fitted models; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
