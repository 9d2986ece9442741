"""Preparing a corpus: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyband.llm import byte_bpe, lsm_dedup, mixture, rule_ensemble, similar_texts
from tallyband.llm.common import table, vocabulary, work_table

#: The corpus after cleaning, as it is to be mixed: every leaf keeps what its weight allows, short ones repeat up to twice.
CORPUS_MIX = mixture.Mixture(mixture.PRODUCTION.weights, share=90, max_epochs=2, seed="corpus-1")
VOCABULARY = "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return rule_ensemble.accepted(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return lsm_dedup.without_duplicates(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are similar by five-word shingles, 0.8 or more, the row with the smallest id stays; candidates by SimHash and pivot distances."""
    return similar_texts.without_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixture.mixed(docs, CORPUS_MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of every row."""
    return byte_bpe.encode_documents(docs, vocabulary(VOCABULARY))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: The first stage learns a model and the last encodes: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
