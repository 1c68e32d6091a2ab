"""Streaming tumbling-window flow features.

``readStream`` -> the same row preparation as the batch operator -> ``withWatermark`` on the event time -> built-in
aggregates per (time slice, label).  Slices are short (``gcd(width, 1 s) / 16``), so a busy window is spread
over many state groups, and rows are summed on the map side before the shuffle.  A group's state is its sums, ends and the
*set* of its times, which has at most as many entries as the slice has microseconds, however many rows come; Spark
drops it once the watermark has passed the slice.  Rows later than that are dropped, too.

In ``update`` mode every micro-batch emits the slices it touched.  ``windows_of_updates`` takes the last update of each slice,
gets the gaps inside it from its times and stitches slices to windows with the batch operator's second half, so a
stream and a batch run give identical values.  Windows are anchored at the epoch (a stream has no global minimum).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.windows import US, floor_div, slice_width_us, windows_of_slices


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def stream_slices(packets: DataFrame, width: int, watermark: str = "10 minutes") -> DataFrame:
    """Slice statistics of a prepared packet stream (ts_us, len_u, binary_label, multiclass_label), for ``update`` mode."""
    slice_us = slice_width_us([int(width) * US])
    timed = packets.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", watermark)
    slices = timed.groupBy(F.window("event_time", f"{slice_us} microseconds").alias("slice"), "multiclass_label").agg(
        F.count(F.lit(1)).alias("n_l"), F.sum(_exact(F.col("len_u"))).alias("b_sum"), F.sum(_exact(F.col("len_u")) * _exact(F.col("len_u"))).alias("b_sq"),
        F.min("len_u").alias("b_min"), F.max("len_u").alias("b_max"), F.min("ts_us").alias("first_l"), F.max("ts_us").alias("last_l"),
        F.max("binary_label").alias("any_attack"), F.collect_set("ts_us").alias("times"))
    return slices.withColumn("slice_id", floor_div(F.unix_micros("slice.start"), slice_us)).drop("slice")


def inner_gaps(times: Column, rows: Column) -> list[Column]:
    """d_min, d_max and d_sq of consecutive times, from the distinct times of a slice and its number of rows; rows beyond the
    distinct times have gaps of 0."""
    order = F.array_sort(times)
    gaps = F.zip_with(F.slice(order, 2, F.size(order)), F.slice(order, 1, F.greatest(F.size(order) - 1, F.lit(0))), lambda b, a: b - a)
    more = F.when(rows > F.size(order), F.lit(0).cast("long"))
    total = F.aggregate(gaps, F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc + _exact(d) * _exact(d)).cast("decimal(38,0)"))
    return [F.least(F.array_min(gaps), more).alias("d_min"), F.greatest(F.array_max(gaps), more).alias("d_max"), total.alias("d_sq")]


def windows_of_updates(updates: DataFrame, width: int) -> DataFrame:
    """Window features from an append-only table of (batch_id, slice updates); the last update of a slice counts."""
    fields = [c for c in updates.columns if c not in ("batch_id", "slice_id", "multiclass_label")]
    last = updates.groupBy("slice_id", "multiclass_label").agg(F.max_by(F.struct(*fields), "batch_id").alias("v")).select("slice_id", "multiclass_label", "v.*")
    #: A slice has few rows, one for each label; its gaps go to the first of them.
    whole = last.groupBy("slice_id").agg(F.array_distinct(F.flatten(F.collect_list("times"))).alias("all_times"), F.sum("n_l").alias("rows"), F.min("multiclass_label").alias("lead"))
    gaps = whole.select(F.col("slice_id").alias("of"), "lead", *inner_gaps(F.col("all_times"), F.col("rows")))
    per_label = last.drop("times").join(gaps, (F.col("slice_id") == F.col("of")) & (F.col("multiclass_label") == F.col("lead")), "left").drop("of", "lead")
    return windows_of_slices(per_label, (int(width),), (), slice_width_us([int(width) * US]))
