"""File manifest verification (S14) - the download check re-aimed at files already in storage.

Files are listed with the ``binaryFile`` source, contents unread; the
executors then stream each file through SHA-256 in small blocks, so a file of any
size takes a task but no memory.  Sizes and hashes are compared with an expected
manifest by a left join.  Status: ok, size_mismatch (< 98 % of the expected
size), hash_mismatch, missing, unexpected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import tasks_for

SIZE_TOLERANCE = 0.98
BLOCK_BYTES = 8 << 20


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from urllib.parse import unquote, urlparse

    from pyarrow import fs as pafs

    for pdf in batches:
        found = []
        for path in pdf["path"]:
            parsed = urlparse(path)
            local = parsed.scheme in ("", "file")
            filesystem, inner = (pafs.LocalFileSystem(), unquote(parsed.path)) if local else pafs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with filesystem.open_input_stream(inner) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
            found.append(digest.hexdigest())
        yield pd.DataFrame({"path": pdf["path"], "size_bytes": pdf["size_bytes"], "sha256": found})


def file_digests(spark: SparkSession, path: str, glob: str = "*", name_pattern: str = r"([^/]+)$", tasks: int | None = None) -> DataFrame:
    """(name, path, size_bytes, sha256) of every file below ``path``; ``name_pattern`` takes the name from the path."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
             .load(path).select("path", F.col("length").alias("size_bytes")))
    read = files.repartition(tasks or tasks_for(spark, files.count()), "path").mapInPandas(_digests, "path string, size_bytes long, sha256 string")
    return read.select(F.regexp_extract("path", name_pattern, 1).alias("name"), "path", "size_bytes", "sha256")


def verify_manifest(digests: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare with ``expected`` (name, expected_size, expected_sha256 - either may be null)."""
    j = expected.withColumn("_expected", F.lit(True)).join(digests, "name", "full_outer")
    status = (F.when(F.col("path").isNull(), F.lit("missing"))
              .when(F.col("_expected").isNull(), F.lit("unexpected"))
              .when(F.col("expected_size").isNotNull() & (F.col("size_bytes") < F.col("expected_size") * SIZE_TOLERANCE),
                    F.lit("size_mismatch"))
              .when(F.col("expected_sha256").isNotNull() & (F.lower("expected_sha256") != F.col("sha256")),
                    F.lit("hash_mismatch"))
              .otherwise(F.lit("ok")))
    return j.select("name", "path", "size_bytes", "sha256", "expected_size", "expected_sha256", status.alias("status"))
