"""Token counts by the whole-token shortcut (operator 1)."""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.bpe import counter
from flowlens.llm.common import llm_query

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


def n_tokens(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of a text, as the library counts them without special tokens at its ends.

    Null and empty texts have 0 tokens; texts of any length are counted whole.  The table is proven
    once for each worker from the vocabulary file alone.  ``vocabulary`` is the path of a byte-level
    BPE file that every executor can open.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        c = counter(path)
        return pa.array([c.count(t.as_py()) for t in texts], pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, text: str = "text", limit: int = LIMIT, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens); row by row, no shuffle.

    Columns of these names are replaced; repeated rows each keep their count.
    """
    counted = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": n_tokens(F.col(text), vocabulary)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@llm_query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
