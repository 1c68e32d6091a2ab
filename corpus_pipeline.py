"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame.  Its result is written as Parquet and
read again as the next one's documents, so a stage that fails can be run again from its input.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm.common import stored
from flowlens.llm.exact_dedup import keep_first_copies
from flowlens.llm.jaccard_join import keep_one_of_each
from flowlens.llm.mixing import mix_documents
from flowlens.llm.packing import pack_documents
from flowlens.llm.quality_model import with_quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on the labels, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_quality(docs, labels).where("predicted = 1").select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return keep_first_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a Jaccard similarity of 0.8."""
    return keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once or twice; twice means two rows."""
    return mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix in sequences of 2,048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs)


STAGES = [("quality", good_documents), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: A trained classifier, tokens and random draws are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
