"""Shared helpers of the corpus operators: text rules, stored tables, query registry."""

from __future__ import annotations

import ctypes
import functools
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.session import scratch_path

#: White space of every contract of this package, as the inside of a character class (Java and Python).
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def llm_query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``, with DuckDB SQL where SQL can express it."""

    def wrap(fn):
        LLM_QUERIES[name] = fn
        if oracle is not None:
            LLM_ORACLES[name] = oracle
        return fn

    return wrap


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table below the shared checkpoint folder and read it back.

    Cuts the lineage: the table outlives any executor, and its size is known to later joins.
    Every call takes a new folder, so reruns never meet old files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    for paths in getattr(_OPEN, "scopes", []):
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


_OPEN = threading.local()


def tidied(operator):
    """An operator that deletes the tables it has ``stored``, but for those that its result (a DataFrame, or a tuple
    with some) still reads."""

    @functools.wraps(operator)
    def run(*args, **named):
        scopes = _OPEN.__dict__.setdefault("scopes", [])
        scopes.append([])
        try:
            result = operator(*args, **named)
        finally:
            paths = scopes.pop()
        frames = [r for r in (result if isinstance(result, tuple) else (result,)) if isinstance(r, DataFrame)]
        used = {f.rpartition("/")[0].rpartition("/")[2] for r in frames for f in r.inputFiles()}
        for path in paths:
            if path.rpartition("/")[2] not in used:
                _delete(frames[0].sparkSession, path)
        return result

    return run


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a stored table has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def release() -> None:
    """Give memory that a worker has freed back to the system, before it waits for its next task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(work):
    """A function over Arrow batches, over one group, or over two groups of one key, that releases its memory when it is done."""

    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    def over_group(table: pa.Table) -> pa.Table:
        out = work(table)
        release()
        return out

    def over_groups(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        release()
        return out

    if "pa.Table" not in str(work.__annotations__.get("return")):
        return over_batches
    return over_group if work.__code__.co_argcount == 1 else over_groups


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... within each key, without a task per key: hash buckets cut every key, and a
    bucket's first number comes from the (key, bucket) counts.  Rows that ``order`` doesn't tell apart are equal."""
    bucket, first, n = (f"_{out}_{x}" for x in ("bucket", "first", "n"))
    cut = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets or 4 * partitions(df.sparkSession))))
    counts = cut.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    same = [f"_{out}_{k}" for k in keys]
    starts = counts.select(*[F.col(k).alias(s) for k, s in zip(keys, same, strict=True)], F.col(bucket).alias(f"{bucket}2"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    place = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(s)) for k, s in zip(keys, same, strict=True)])
    joined = cut.withColumn(n, place).join(starts, on & (F.col(bucket) == F.col(f"{bucket}2")))
    return joined.withColumn(out, F.col(first) + F.col(n)).drop(bucket, f"{bucket}2", first, n, *same)


def whole_rows(docs: DataFrame, **more: Column) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, beside other columns: whatever ``docs``' columns are called, names of an
    operator's own don't clash with them.  ``row.*`` gives them back."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in more.items()])


def first_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, row): of each group the ``row`` that comes first by a digest of it."""
    return rows.groupBy(*keys).agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))


def collapse_spaces(text: Column) -> Column:
    """Every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0), without building the words.

    Every run of white space becomes one space; words are then one more than the spaces
    between the trimmed ends.
    """
    one = F.btrim(collapse_spaces(text), F.lit(" "))
    spaces = F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit("")))
    return F.when(one == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most ``rows`` rows: what a worker builds for a piece is gone before the next."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
