"""Tumbling-window flow features (packets -> per-window statistics).

Plan shape (per call, any number of window widths at once):

1. ``prepare_packets``: coerce time to integer microseconds and length to
   integer milli-units, drop rows without time/length/label, map labels.
2. Rows are cut into *time slices*, up to 16 of them in ``gcd(widths, 1 s)``.  One shuffle on
   ``(keys, slice)`` feeds a ``lag`` window (consecutive inter-arrival
   times inside the slice) and one aggregate per (slice, label) that reuses
   the same partitioning.  A slice is at most a sixteenth of a second of traffic, so a
   long window or a busy second is spread over many tasks instead of landing in one.
3. The (slice, label) rows are exploded over the widths and shuffled once
   on the window keys; window functions over that partitioning give each
   slice's first time and the end of the previous non-empty slice (the gap
   between neighbouring slices, counted once per slice); two aggregates -
   per (window, label), then per window with the majority label - reuse the
   same partitioning.  One scan, one row-level and one slice-level shuffle.

All sums are over integers (decimal(38,0)), so results do not depend on
partitioning or row order; every float is derived from exact totals.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.labels import label_to_binary

US = 1_000_000
LEN_SCALE = 1000  # lengths are summed as integer milli-units

WINDOW_COLUMNS = (
    "binary_label", "multiclass_label", "window_seconds", "packet_count", "byte_sum", "byte_mean",
    "byte_std", "byte_min", "byte_max", "duration", "packets_per_second", "bytes_per_second",
    "iat_mean", "iat_std", "iat_min", "iat_max", "burstiness", "mixed_label_ratio",
)


def time_to_micros(df: DataFrame, column: str) -> Column:
    """Integer epoch microseconds from a timestamp or a number of seconds."""
    dtype = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_micros(c.cast("timestamp"))
    seconds = c.cast("double") if isinstance(dtype, T.NumericType) else c.try_cast("double")
    return F.floor(seconds * F.lit(float(US)) + F.lit(0.5)).cast("long")


def to_units(c: Column, scale: int = LEN_SCALE) -> Column:
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)).cast("long")


def prepare_packets(df: DataFrame, ts: str = "timestamp", length: str = "tcp_len", label: str = "label",
                    keys: tuple[str, ...] = (), label_map=None, default_binary=None, match: str = "substring",
                    len_scale: int = LEN_SCALE) -> DataFrame:
    """Rows -> (keys, ts_us, len_u, binary_label, multiclass_label); rows missing any of them dropped."""
    dtype = df.schema[length].dataType
    length_col = F.col(length).cast("double") if isinstance(dtype, T.NumericType) else F.col(length).try_cast("double")
    out = df.select(
        *[F.col(k) for k in keys],
        time_to_micros(df, ts).alias("ts_us"),
        to_units(F.when(~F.isnan(length_col), length_col), len_scale).alias("len_u"),
        label_to_binary(F.col(label), match=match, label_map=label_map, default=default_binary).alias("binary_label"),
        F.trim(F.col(label).cast("string")).alias("multiclass_label"),
    )
    return out.where(F.col("ts_us").isNotNull() & F.col("len_u").isNotNull() & F.col("multiclass_label").isNotNull()
                     & F.col("binary_label").isNotNull())


def floor_div(x: Column, d) -> Column:
    """Exact integer floor division (also for negative x).

    ``x - pmod(x, d)`` is an exact multiple of ``d``; dividing two such
    integers below 2**53 as doubles gives the exact quotient.
    """
    d = d if isinstance(d, Column) else F.lit(int(d))
    x = x.cast("long")
    return ((x - F.pmod(x, d)) / d).cast("long")


def _dec(c: Column) -> Column:
    return c.cast("decimal(20,0)")


#: Slices in the longest stretch that fits a second and all widths; fewer if it can't be cut evenly.
SLICES = 16


def slice_width_us(widths_us: list[int], slices: int = SLICES) -> int:
    """Width of the time slices: it divides every window."""
    whole = reduce(gcd, widths_us, US)
    return whole // max(k for k in range(1, slices + 1) if whole % k == 0)


def window_features(packets: DataFrame, widths=(1, 5, 10), keys: tuple[str, ...] = (), anchor: str | int = "min",
                    len_scale: int = LEN_SCALE) -> DataFrame:
    """Per (keys, window_seconds, window_id) flow statistics.

    ``packets`` comes from :func:`prepare_packets`.  ``anchor="min"``
    starts windows at the smallest timestamp of the input (one scalar
    aggregate); ``"epoch"`` or an integer microsecond value anchors them
    at a fixed origin (needed for streams).
    """
    widths_us = [int(round(float(w) * US)) for w in widths]
    slice_us = slice_width_us(widths_us)
    if anchor == "min":
        t0 = packets.agg(F.min("ts_us")).first()[0]
        if t0 is None:
            t0 = 0
    elif anchor == "epoch":
        t0 = 0
    else:
        t0 = int(anchor)
    keys = tuple(keys)
    rows = packets.withColumn("slice_id", floor_div(F.col("ts_us") - F.lit(t0), slice_us))
    by_slice = Window.partitionBy(*keys, "slice_id").orderBy("ts_us")
    rows = rows.withColumn("d_us", F.col("ts_us") - F.lag("ts_us").over(by_slice))

    # one aggregate per (slice, label) over the window's partitioning (hash on keys + slice satisfies
    # the clustering on keys + slice + label, so no further exchange)
    per_label = rows.groupBy(*keys, "slice_id", "multiclass_label").agg(
        F.count(F.lit(1)).alias("n_l"),
        F.sum(_dec(F.col("len_u"))).alias("b_sum"),
        F.sum(_dec(F.col("len_u")) * _dec(F.col("len_u"))).alias("b_sq"),
        F.min("len_u").alias("b_min"),
        F.max("len_u").alias("b_max"),
        F.min("ts_us").alias("first_l"),
        F.max("ts_us").alias("last_l"),
        F.min("d_us").alias("d_min"),
        F.max("d_us").alias("d_max"),
        F.sum(_dec(F.col("d_us")) * _dec(F.col("d_us"))).alias("d_sq"),
        F.max("binary_label").alias("any_attack"),
    )

    return windows_of_slices(per_label, widths, keys, slice_us, len_scale)


def windows_of_slices(per_label: DataFrame, widths, keys: tuple[str, ...], slice_us: int, len_scale: int = LEN_SCALE) -> DataFrame:
    """Window statistics from one row per (keys, slice_id, multiclass_label): counts, sums, ends and inner gaps; gaps
    between neighbouring slices are stitched."""
    widths_us = [int(round(float(w) * US)) for w in widths]
    width_col = F.explode(F.array(*[F.struct(F.lit(w).alias("ws"), F.lit(wu).alias("wu"))
                                    for w, wu in zip(widths, widths_us)])).alias("w")
    wkeys = (*keys, "window_seconds", "window_id")
    sl = (per_label.select("*", width_col)
          .select("*", F.col("w.ws").alias("window_seconds"),
                  floor_div(F.col("slice_id") * F.lit(slice_us), F.col("w.wu")).alias("window_id"))
          .drop("w"))
    # slice-level rows (one per slice and label) of a window share one exchange on the window keys:
    # the slice's first/last time, the end of the previous non-empty slice (range frame over slice ids)
    # and the gap between them, counted once per slice
    in_slice = Window.partitionBy(*wkeys, "slice_id")
    before = Window.partitionBy(*wkeys).orderBy("slice_id").rangeBetween(Window.unboundedPreceding, -1)
    sl = (sl.withColumn("s_first", F.min("first_l").over(in_slice))
          .withColumn("prev_last", F.max("last_l").over(before))
          .withColumn("_lead", F.row_number().over(in_slice.orderBy("multiclass_label")) == 1)
          .withColumn("gap", F.when(F.col("_lead"), F.col("s_first") - F.col("prev_last"))))
    by_label = sl.groupBy(*wkeys, "multiclass_label").agg(
        F.sum("n_l").alias("n_l"), F.min("first_l").alias("first_l"), F.max("last_l").alias("last_l"),
        F.sum("b_sum").alias("b_sum"), F.sum("b_sq").alias("b_sq"), F.min("b_min").alias("b_min"),
        F.max("b_max").alias("b_max"),
        F.least(F.min("d_min"), F.min("gap")).alias("d_min"), F.greatest(F.max("d_max"), F.max("gap")).alias("d_max"),
        (F.coalesce(F.sum("d_sq"), F.lit(0).cast("decimal(38,0)"))
         + F.coalesce(F.sum(_dec(F.col("gap")) * _dec(F.col("gap"))), F.lit(0).cast("decimal(38,0)"))).alias("d_sq"),
        F.max("any_attack").alias("any_attack"))
    joined = by_label.groupBy(*wkeys).agg(
        F.sum("n_l").alias("packet_count"), F.sum("b_sum").alias("b_sum"), F.sum("b_sq").alias("b_sq"),
        F.min("b_min").alias("b_min"), F.max("b_max").alias("b_max"), F.min("first_l").alias("first_us"),
        F.max("last_l").alias("last_us"), F.min("d_min").alias("d_min"), F.max("d_max").alias("d_max"),
        F.sum("d_sq").alias("d_sq"), F.max("any_attack").alias("binary_label"),
        F.min_by(F.struct("multiclass_label", "n_l"),
                 F.struct(-F.col("n_l"), F.col("first_l"), F.col("multiclass_label"))).alias("maj"))
    return _finish(joined, keys, len_scale)


def _finish(df: DataFrame, keys: tuple[str, ...], len_scale: int) -> DataFrame:
    n = F.col("packet_count").cast("double")
    scale = F.lit(float(len_scale))
    b_sum = F.col("b_sum").cast("double")
    b_sq = F.col("b_sq").cast("double")
    byte_sum = b_sum / scale
    byte_mean = byte_sum / n
    byte_var = (b_sq - b_sum * b_sum / n) / n
    byte_std = F.sqrt(F.greatest(byte_var, F.lit(0.0))) / scale
    span = (F.col("last_us") - F.col("first_us")).cast("double")
    duration = span / F.lit(float(US))
    w = F.col("window_seconds").cast("double")
    m = (F.col("packet_count") - 1).cast("double")
    iat_mu = span / m
    iat_var = F.col("d_sq").cast("double") / m - iat_mu * iat_mu
    many = F.col("packet_count") > 1
    out = df.select(
        *[F.col(k) for k in keys],
        F.col("window_id"),
        F.col("binary_label").cast("int").alias("binary_label"),
        F.col("maj.multiclass_label").alias("multiclass_label"),
        F.col("window_seconds"),
        F.col("packet_count").cast("long").alias("packet_count"),
        byte_sum.alias("byte_sum"),
        byte_mean.alias("byte_mean"),
        byte_std.alias("byte_std"),
        (F.col("b_min").cast("double") / scale).alias("byte_min"),
        (F.col("b_max").cast("double") / scale).alias("byte_max"),
        duration.alias("duration"),
        F.when(span > 0, n / duration).otherwise(n / w).alias("packets_per_second"),
        F.when(span > 0, byte_sum / duration).otherwise(byte_sum / w).alias("bytes_per_second"),
        F.when(many, iat_mu / F.lit(float(US))).otherwise(F.lit(0.0)).alias("iat_mean"),
        F.when(many, F.sqrt(F.greatest(iat_var, F.lit(0.0))) / F.lit(float(US))).otherwise(F.lit(0.0)).alias("iat_std"),
        F.when(many, F.col("d_min").cast("double") / F.lit(float(US))).otherwise(F.lit(0.0)).alias("iat_min"),
        F.when(many, F.col("d_max").cast("double") / F.lit(float(US))).otherwise(F.lit(0.0)).alias("iat_max"),
        F.when(byte_mean > 0, byte_std / byte_mean).otherwise(F.lit(0.0)).alias("burstiness"),
        (F.lit(1.0) - F.col("maj.n_l").cast("double") / n).alias("mixed_label_ratio"),
    )
    return out


def window_profile(windows: DataFrame, n_columns: int = len(WINDOW_COLUMNS)) -> DataFrame:
    """Rows, column count, mixed windows and mean mixed-label ratio per width."""
    return windows.groupBy("window_seconds").agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(n_columns).alias("columns"),
        F.count_if(F.col("mixed_label_ratio") > 0).alias("mixed_windows"),
        F.round(F.avg("mixed_label_ratio"), 9).alias("mean_mixed_label_ratio"),
    )
