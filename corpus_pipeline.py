"""A training corpus from raw documents: five stages, each written and read again.

Toxic documents go, then exact copies, then near copies; what is left is mixed
to its sources' target weights and packed into sequences.  Every stage but the
last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from lodestone.llm.common import read_table, stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it is fitted on labelled rows of docs."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text (lower-cased A-Z), that with the largest identifier."""
    return exact_dedup.keep_distinct(docs, keep="max")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest identifier."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources weigh as the square root of their size."""
    out = mixing.mix(docs)
    return out.drop(out.columns[-1])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents at their place in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs))[0]


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("mix_sources", mixed),
    ("best_fit_packing", packed),
]

#: A trained classifier and sampled signatures stand in the way of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
