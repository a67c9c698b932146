"""Cleaning pipeline for a training corpus: each stage applies one operator to all that the stage before it kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. All but the last return
the columns of ``documents``. Rows with a null id are kept by all stages but exact dedup, which treats them like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripscope.llm import exact_dedup, near_dup, packing, suffix_dedup, toxicity
from tripscope.llm.common import documents, table, written


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity grammar, learned from ``labels``, scores at 0.5 or more."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a similarity of 0.8 or more over shingles of five words."""
    return near_dup.drop_near_copies(docs, words=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every byte covered by a 200-byte string that starts anywhere else; all rows stay."""
    return suffix_dedup.cut_repeats(docs, 200)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [("toxicity", clean_language), ("exact dedup", exact), ("near dedup", near), ("suffix dedup", passages), ("packing", packed)]

#: The stages learn, link by similarity and pack; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
