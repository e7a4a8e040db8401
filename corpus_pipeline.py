"""From raw documents to packed training sequences: the stages of ``axistab.llm`` in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axistab.llm import exact_dedup, mixing, packing, quality_rules, similar
from axistab.llm.common import read_table, stage
from axistab.llm.queries import tokenizer
from axistab.sources.ship import ship


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    ship(spark)
    return quality_rules.drop_low_quality(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    ship(spark)
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word similarity of 0.8 or more."""
    ship(spark)
    return similar.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    ship(spark)
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences."""
    ship(spark)
    return packing.pack(docs, tokenizer())


STAGES = [("quality_rules", rules), ("exact_dedup", copies), ("near_dedup", near_copies), ("mix_sources", mix), ("best_fit_packing", sequences)]
#: Token ids, fingerprints and evolved packings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is staged for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        docs = stage(docs, name) if i < len(STAGES) - 1 else docs
    return docs
