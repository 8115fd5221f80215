"""The corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of ``documents``; each result is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import jaccard, packing, quality, repeats, toxicity
from quirefold.llm.common import crc_fold, table
from quirefold.llm.queries import vocabulary
from quirefold.session import cut_lineage

TOXIC = 0.7


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their host's verdict."""
    return quality.keep_documents(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below ``TOXIC``; labels of the third fold are not learned from."""
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 3) != 1)
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels), docs.columns)
    return scored.where(F.col("score") < TOXIC).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 100 bytes that stand earlier in the corpus."""
    cut = repeats.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in cut.columns else cut


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed_sequences),
]

#: SQL states neither the fitted classifier nor the tokenizer; ``tests/llm`` compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
