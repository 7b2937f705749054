"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import decontaminate, near, packing, simhash, stream_dedup, toxicity
from hushframe.llm.common import table
from hushframe.session import stage


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with identical texts the one with the largest id stays."""
    return stream_dedup.keep_one(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Linked are fingerprints (SimHash, as in op6) at most four bits apart and sets of five-word runs with a Jaccard similarity
    of 0.8 or more, most of which SimHash alone misses.
    """
    return near.keep_one(docs, radius=simhash.RADIUS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.mark(docs, packing.public_tokenizer())


STAGES = [("toxicity", clean), ("exact dedup", exact), ("near-duplicates", distinct), ("decontamination", decontaminated), ("packing", packed)]

#: The classifier's and the packer's rows have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
