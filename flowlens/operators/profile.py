"""One-pass table profiling."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.names import norm
from flowlens.vocab import LABEL_EXACT, LABEL_TOKENS, LEAKAGE_TOKENS, SENSITIVE_TOKENS

FEW_VALUES, FEW_CODES = 50, 5
HASH_SLOTS = 4096


def null_expr(df: DataFrame, column: str):
    """Missing in the pandas sense: null, or NaN for floating columns."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def columns_table(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(dataset, ordinal, column, dtype) for every column of every frame (schema sized)."""
    rows = [(name, i, f.name, f.dataType.simpleString())
            for name, df in frames.items() for i, f in enumerate(df.schema.fields)]
    schema = "dataset string, ordinal int, column string, dtype string"
    return spark.createDataFrame(rows, schema)


def suspicious_fields(columns: list[str], tokens) -> list[str]:
    return [c for c in columns if any(t in norm(c) for t in tokens)]


def few_valued(df: DataFrame, columns: list[str], most: int = FEW_VALUES) -> dict[str, int]:
    """Exact distinct counts of the columns that have at most ``most`` values, over all rows.

    The first aggregate counts hash slots, of which a column has no more than values: a bounded set per
    column that rules out the others.  Only what is left is counted exactly.
    """
    if not columns:
        return {}
    slots = df.agg(*[F.size(F.collect_set(F.pmod(F.xxhash64(c), F.lit(HASH_SLOTS)))).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    left = [c for i, c in enumerate(columns) if slots[f"n{i}"] <= most + 1]
    if not left:
        return {}
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(f"n{i}") for i, c in enumerate(left)]).first()
    return {c: exact[f"n{i}"] for i, c in enumerate(left) if exact[f"n{i}"] <= most}


def label_points(df: DataFrame) -> dict[str, int]:
    """Points of each column as a label: 3 for a telling name, 1 for 2 to 50 values, 1 for a number of up to 5 values."""
    values = few_valued(df, df.columns)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    rules = [(3, lambda c: any(t in c.lower() for t in LABEL_TOKENS)),
             (1, lambda c: values.get(c, 0) > 1),
             (1, lambda c: c in numeric and values.get(c, FEW_CODES + 1) <= FEW_CODES)]
    return {c: sum(points for points, holds in rules if holds(c)) for c in df.columns}


def detect_label_column(df: DataFrame, min_score: int = 1) -> str | None:
    """The column with an exact label name, in their fixed order, else the one with the most points over the whole
    table (the smaller name of equals); None below ``min_score`` points."""
    exact = min((LABEL_EXACT.index(c.lower().strip()), c) for c in df.columns if c.lower().strip() in LABEL_EXACT) if any(
        c.lower().strip() in LABEL_EXACT for c in df.columns) else None
    if exact:
        return exact[1]
    ranked = sorted((-p, c) for c, p in label_points(df).items() if p >= max(1, min_score))
    return ranked[0][1] if ranked else None


def table_profile(df: DataFrame, dataset: str, label_column: str | None = None) -> DataFrame:
    """rows, columns, missing cells and ratio, label column, suspicious names: one aggregate."""
    cols = df.columns
    missing = reduce(lambda a, b: a + b, [F.count_if(null_expr(df, c)) for c in cols], F.lit(0).cast("long"))
    n = F.count(F.lit(1))
    agg = df.agg(n.alias("rows"), missing.alias("missing_cells"))
    return agg.select(
        F.lit(dataset).alias("dataset"),
        F.col("rows"),
        F.lit(len(cols)).alias("columns"),
        F.col("missing_cells"),
        F.when(F.col("rows") > 0, F.col("missing_cells") / (F.col("rows") * F.lit(len(cols)))).alias("missing_value_ratio"),
        F.lit(label_column).cast("string").alias("label_column"),
        F.lit(";".join(suspicious_fields(cols, LEAKAGE_TOKENS))).alias("suspicious_leakage_fields"),
        F.lit(";".join(suspicious_fields(cols, SENSITIVE_TOKENS))).alias("suspicious_sensitive_fields"),
        F.lit("ok").alias("read_status"),
    )


FILE_PROFILE = ("dataset string, file_path string, size_bytes long, rows long, columns int, fields string, label_column string, label_distribution string, "
                "missing_value_ratio double, suspicious_leakage_fields string, suspicious_sensitive_fields string, read_status string")


def file_profiles(spark: SparkSession, dataset: str, files: list[tuple[str, int]], read: Callable[[SparkSession, str], DataFrame], at_once: int = 8) -> DataFrame:
    """A row for each of ``files`` (path, size); a file that can't be read becomes a status row, the others go on.

    ``read`` opens a path.  Files are profiled side by side, a few at a time; each is two aggregates over its rows.  Lists and the
    label counts (largest first) are JSON text.
    """
    def one(file: tuple[str, int]) -> tuple:
        path, size = file
        try:
            df = read(spark, path)
            label = "multiclass_label" if "multiclass_label" in df.columns else detect_label_column(df)
            row = table_profile(df, dataset, label).first()
            counts = label_distribution(df, dataset, label).orderBy(F.desc("count"), "label_value") if label else None
            told = {r["label_value"]: r["count"] for r in counts.select("label_value", "count").collect()} if counts is not None else {}
        except Exception as error:  # noqa: BLE001 - whatever a reader raises is the file's status
            return (dataset, path, size, None, None, "[]", None, "{}", None, "[]", "[]", f"failed: {type(error).__name__}: {str(error)[:300]}")
        lists = [json.dumps(suspicious_fields(df.columns, t), ensure_ascii=False) for t in (LEAKAGE_TOKENS, SENSITIVE_TOKENS)]
        return (dataset, path, size, row["rows"], len(df.columns), json.dumps(df.columns, ensure_ascii=False), label, json.dumps(told, ensure_ascii=False), row["missing_value_ratio"], *lists, "ok")

    with ThreadPoolExecutor(at_once) as pool:
        return spark.createDataFrame(list(pool.map(one, files)), FILE_PROFILE)


def label_distribution(df: DataFrame, dataset: str, label_column: str) -> DataFrame:
    """count and share per label value (null as '<NA>'), largest first."""
    value = F.coalesce(F.col(label_column).cast("string"), F.lit("<NA>"))
    counts = df.groupBy(value.alias("label_value")).agg(F.count(F.lit(1)).alias("count"))
    total = F.lit(df.count())
    return counts.select(
        F.lit(dataset).alias("dataset"), F.lit(label_column).alias("label_column"), "label_value", "count",
        (F.col("count") / total).alias("percent"))


def column_missing(df: DataFrame, dataset: str) -> DataFrame:
    """Per-column missing counts: one aggregate, then unpivot of its single row."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(null_expr(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    stacked = one.select(
        "__rows",
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"))
                            for i, c in enumerate(cols)])).alias("s"))
    return stacked.select(
        F.lit(dataset).alias("dataset"), F.col("s.column").alias("column"), F.col("s.missing").alias("missing"),
        F.when(F.col("__rows") > 0, F.col("s.missing") / F.col("__rows")).alias("missing_ratio"))
