"""A corpus from raw documents to packed training sequences.

Each stage applies one operator of tablecheck.llm to all its predecessor kept; its
result is written and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecheck.llm.base import cut, table
from tablecheck.llm.mixing import mix
from tablecheck.llm.neardup import deduplicate
from tablecheck.llm.packing import pack
from tablecheck.llm.quality import keep_good
from tablecheck.llm.substrings import WORDS, remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go, or whose source fails them too often."""
    return keep_good(docs, "source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and strings of 400 bytes or more, that occur again
    are cut out of the texts."""
    out = remove_repeats(docs, docs.columns, keep_text=True, words=WORDS).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs, docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences."""
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", packed),
]

ORACLE_SQL = None  # near-duplicates and repeated strings have no SQL form of usable cost


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
