"""Sinks (K1-K4): partitioned parquet for tables and views, CSV/JSON for small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowlens.operators.views import project_view


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """K1: parquet, optionally partitioned (e.g. by window_seconds or dataset/policy/view_role)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: a report table as CSV with a header in each file (arrays/maps as JSON text); a small table is one file."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: metadata documents (one JSON object per row)."""
    df.write.mode(mode).json(path)


def write_view(df: DataFrame, features: list[str], path: str, mode: str = "overwrite") -> None:
    """K4: label columns first, then the view's features."""
    write_table(project_view(df, features), path, mode=mode)
