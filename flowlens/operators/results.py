"""Result-table operators over metric runs.

A run table has one row per evaluated configuration (dataset, view, task,
model, split type, seed, status, metrics...).  It is small compared with the
data, but every operator here is still a grouped aggregate or a window
partitioned by the grouping keys - never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seed_stability(runs: DataFrame, keys: list[str], metrics=("macro_f1", "weighted_f1", "pr_auc"),
                   digits: int = 9) -> DataFrame:
    """Mean and *sample* std over seeds of ok runs; n_runs counts non-null macro_f1."""
    ok = runs.where(F.col("status") == "ok")
    aggs = []
    for m in metrics:
        aggs += [F.round(F.avg(m), digits).alias(f"{m}_mean"), F.round(F.stddev_samp(m), digits).alias(f"{m}_std")]
    return ok.groupBy(*keys).agg(*aggs, F.count(metrics[0]).alias("n_runs"))


def best_by(runs: DataFrame, keys: list[str], metric: str = "macro_f1", tiebreak: str = "model") -> DataFrame:
    """A3: the whole best ok row per key (highest metric, then ``tiebreak`` ascending)."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(metric), F.asc(tiebreak))
    ok = runs.where(F.col("status") == "ok")
    return ok.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def argmax_row(runs: DataFrame, keys: list[str], metric: str = "macro_f1", value: str = "model") -> DataFrame:
    """A4: value of the row with the largest metric per key (ties: smallest value), one aggregate.  Rows without a
    metric never win; a key that has only such rows gives nulls."""
    order = F.when(F.col(metric).isNotNull(), F.struct(-F.col(metric), F.col(value)))
    return runs.where(F.col("status") == "ok").groupBy(*keys).agg(
        F.min_by(value, order).alias(f"best_{value}"), F.max(metric).alias(f"best_{metric}"))


def top_k(df: DataFrame, keys: list[str], order_col: str, k: int, tiebreak: str | None = None) -> DataFrame:
    """A5: first k rows per key by ``order_col`` descending (row_number <= k, planned as a group limit)."""
    order = [F.desc_nulls_last(order_col)] + ([F.asc(tiebreak)] if tiebreak else [])
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def delta_vs_baseline(runs: DataFrame, keys: list[str], baseline_col: str, baseline_value: str,
                      metric: str = "macro_f1") -> DataFrame:
    """Metric minus the baseline row's metric within the same keys."""
    w = Window.partitionBy(*keys)
    base = F.max(F.when(F.col(baseline_col) == baseline_value, F.col(metric))).over(w)
    return runs.withColumn(f"{metric}_delta_vs_{baseline_value}", F.col(metric) - base)


def pivot_hue(df: DataFrame, x: str, hue: str, y: str, hues: list[str] | None = None) -> DataFrame:
    """One row per x, one column per hue value (first y)."""
    g = df.groupBy(x)
    g = g.pivot(hue, hues) if hues is not None else g.pivot(hue)
    return g.agg(F.first(y))
