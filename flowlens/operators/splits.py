"""Reproducible samples and train/val/test splits.

Randomness is an md5 order key of ``seed:id`` (identical in DuckDB), not
an RNG, so every split is reproducible on any partitioning.  A split is a
``split`` column on the table, never an index array on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.ranked import HASH_BUCKET_BITS, TIME_BUCKETS, assign_by_cuts, hash_bucket, hash_key, order_bucket, small_side
from flowlens.vocab import GROUP_CANDIDATES, TIME_CANDIDATES

SPLITS = ("train", "val", "test")


def _allocate(counts: DataFrame, label: str, n_col: str, target: int, out: str) -> DataFrame:
    """Largest-remainder allocation of ``target`` rows over classes in proportion to ``n_col``.

    Exact integer arithmetic; ties in the remainder go to the smaller label (null last).
    Works on the class table (one row per class): two sums, and a top-k for the remainders.
    """
    total = int(counts.agg(F.sum(n_col)).first()[0] or 0)
    q = F.lit(target).cast("long") * F.col(n_col)
    base = (q - F.pmod(q, F.lit(total))) / F.lit(total) if total else F.lit(0)
    frac = F.pmod(q, F.lit(total)) if total else F.lit(0)
    step = counts.withColumn(out, base.cast("long")).withColumn("_frac", frac.cast("long"))
    extra = target - int(step.agg(F.sum(out)).first()[0] or 0)
    if extra > 0:
        top = step.orderBy(F.desc("_frac"), F.col(label).asc_nulls_last()).limit(extra).select(F.col(label).alias("_one_more"))
        top = small_side(top.withColumn("_add", F.lit(1)))
        step = step.join(top, F.col(label).eqNullSafe(F.col("_one_more")), "left").withColumn(
            out, F.col(out) + F.coalesce("_add", F.lit(0))).drop("_one_more", "_add")
    return step.drop("_frac")


def stratified_cuts(df: DataFrame, label: str, test_size: float = 0.30, val_share: float = 0.50) -> DataFrame:
    """Per class: n, train, val and the rank cuts (train | val | test); a null label is a class.

    Totals follow the usual shuffle-split rules: n_test = ceil(test_size * n),
    then the held-out part is split again with ceil(val_share * n_held) test
    rows.  Per-class train counts are a largest-remainder allocation.
    """
    return stratified_cuts_from_counts(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c")), label, test_size, val_share)


#: Class tables of up to this many rows are allotted on the driver, in one job; larger ones by Spark, with the same result.
DRIVER_CLASSES = 10_000


def _shares(sizes: list[int], target: int) -> list[int]:
    """Largest-remainder shares of ``target`` for sizes in label order; ties go to the earlier label."""
    total = sum(sizes)
    out = [target * n // total if total else 0 for n in sizes]
    rest = sorted(range(len(sizes)), key=lambda k: (-(target * sizes[k] % total if total else 0), k))
    for k in rest[: target - sum(out)]:
        out[k] += 1
    return out


def _few_cuts(rows: list, label: str, test_size: float, val_share: float) -> list[tuple]:
    """The rows of :func:`stratified_cuts` for a class table on the driver."""
    rows = sorted(rows, key=lambda r: (r[label] is None, 0 if r[label] is None else r[label]))
    n = [r["n_c"] for r in rows]
    train = _shares(n, sum(n) - math.ceil(test_size * sum(n)))
    held = [a - b for a, b in zip(n, train, strict=True)]
    val = _shares(held, sum(held) - math.ceil(val_share * sum(held)))
    return [(r[label], c, t, v, t, t + v) for r, c, t, v in zip(rows, n, train, val, strict=True)]


def stratified_cuts_from_counts(counts: DataFrame, label: str, test_size: float = 0.30, val_share: float = 0.50,
                                n_col: str = "n_c") -> DataFrame:
    """:func:`stratified_cuts` from a class-count table (one row per class)."""
    counts = counts.withColumnRenamed(n_col, "n_c") if n_col != "n_c" else counts
    rows = counts.select(label, "n_c").limit(DRIVER_CLASSES + 1).collect()
    if len(rows) <= DRIVER_CLASSES:
        names = ("n_c", "train_c", "val_c", "cut_train", "cut_val")
        schema = T.StructType([T.StructField(label, counts.schema[label].dataType), *[T.StructField(c, T.LongType()) for c in names]])
        return counts.sparkSession.createDataFrame(_few_cuts(rows, label, test_size, val_share), schema)
    n = int(counts.agg(F.sum("n_c")).first()[0] or 0)
    cuts = _allocate(counts, label, "n_c", n - math.ceil(test_size * n), "train_c")
    cuts = cuts.withColumn("held_c", F.col("n_c") - F.col("train_c"))
    n_held = int(cuts.agg(F.sum("held_c")).first()[0] or 0)
    cuts = _allocate(cuts, label, "held_c", n_held - math.ceil(val_share * n_held), "val_c")
    return (cuts.withColumn("cut_train", F.col("train_c"))
            .withColumn("cut_val", F.col("train_c") + F.col("val_c"))
            .select(label, "n_c", "train_c", "val_c", "cut_train", "cut_val"))


def random_stratified_split(df: DataFrame, label: str, id_cols: list[str], seed: int = 42, test_size: float = 0.30,
                            val_share: float = 0.50, out: str = "split", bits: int = HASH_BUCKET_BITS, only: str | None = None,
                            bucket: str | None = None) -> DataFrame:
    """70/15/15 stratified split; within a class rows are ordered by md5(seed:id).  Rows with a null label are a
    class of their own.  ``bits`` sets the number of rank buckets and never the result; ``only`` names the one part to return; ``bucket`` a stored column with the
    rank bucket, if there is one: keys are then made only for the rows that must be ranked."""
    key = hash_key(seed, *id_cols)
    keyed = df.withColumn("_bucket", F.col(bucket) if bucket else hash_bucket(key, bits))

    def cuts(totals: DataFrame) -> DataFrame:  # class totals come from the offsets table
        return stratified_cuts_from_counts(totals, label, test_size, val_share, n_col="n_stratum").select(
            label, "cut_train", "cut_val")

    out_df = assign_by_cuts(keyed, [label], "_bucket", ["_key", *id_cols], cuts, ["cut_train", "cut_val"],
                            list(SPLITS), out=out, only=only, late={"_key": key})
    return out_df.drop("_bucket")


def find_group_field(df: DataFrame, candidates=GROUP_CANDIDATES) -> str | None:
    """First candidate column (case-insensitive) with more than one distinct value."""
    low = {c.lower(): c for c in df.columns}
    present = [low[c] for c in candidates if c in low]
    if not present:
        return None
    # more than one distinct non-null value  <=>  min != max (one aggregate, no shuffle)
    row = df.agg(*[(F.min(c) != F.max(c)).alias(f"g{i}") for i, c in enumerate(present)]).first()
    for i, c in enumerate(present):
        if row[f"g{i}"]:
            return c
    return None


def group_split(df: DataFrame, group: str, seed: int = 42, train_size: float = 0.70, val_share: float = 0.50,
                out: str = "split") -> DataFrame:
    """Groups never shared: groups ordered by md5(seed:group); floor(0.7 G) train groups,
    then floor(0.5 G_rest) validation groups, the rest test.  Null group = '<NA>'."""
    gkey = F.coalesce(F.col(group).cast("string"), F.lit("<NA>"))
    groups = df.select(gkey.alias("_group")).distinct()
    groups = groups.withColumn("_key", hash_key(seed, "_group")).withColumn("_bucket", hash_bucket(F.col("_key")))
    def cuts(totals: DataFrame) -> DataFrame:
        g = F.col("n_stratum")
        return totals.select(
            F.floor(F.lit(train_size) * g).cast("long").alias("cut_train"),
            (F.floor(F.lit(train_size) * g) + F.floor(F.lit(val_share) * (g - F.floor(F.lit(train_size) * g))))
            .cast("long").alias("cut_val"))
    labelled = assign_by_cuts(groups, [], "_bucket", ["_key", "_group"], cuts, ["cut_train", "cut_val"], list(SPLITS),
                              out=out).select("_group", out)
    # group table: one row per group; AQE broadcasts it when it is small, else a shuffle join
    return df.withColumn("_group", gkey).join(labelled, on="_group", how="inner").drop("_group")


def find_time_field(columns: list[str], candidates=TIME_CANDIDATES) -> str | None:
    low = {c.lower(): c for c in columns}
    for c in candidates:
        if c in low:
            return low[c]
    return None


def time_block_split(df: DataFrame, order_cols: list[str], train: float = 0.70, val: float = 0.15,
                     buckets: int = TIME_BUCKETS, out: str = "split", only: str | None = None) -> DataFrame:
    """First floor(0.7 n) rows in time order train, next floor(0.15 n) val, rest test; null times come last.

    ``order_cols`` = time column (timestamp, date or number) first, then a unique numeric id (total
    order).  Time is cut at quantiles and a burst of equal times at quantiles of the id, so
    it is ranked bucket by bucket.  ``buckets`` never changes the result; ``only`` names the one part to return.
    """
    keyed = order_bucket(df, order_cols, buckets=buckets, ties=buckets, out="_bucket")

    def cuts(totals: DataFrame) -> DataFrame:
        n = F.col("n_stratum")
        return totals.select(F.floor(F.lit(train) * n).cast("long").alias("cut_train"),
                             (F.floor(F.lit(train) * n) + F.floor(F.lit(val) * n)).cast("long").alias("cut_val"))
    order = [F.col(c).asc_nulls_last() for c in order_cols]
    return assign_by_cuts(keyed, [], "_bucket", order, cuts, ["cut_train", "cut_val"], list(SPLITS),
                          out=out, only=only).drop("_bucket")


def available_splits(df: DataFrame) -> list[tuple[str, str | None]]:
    """(split type, field) that a table allows: the random split always, the group split with the first
    group field of more than one value, the time-block split with the first time field."""
    group, time = find_group_field(df), find_time_field(df.columns)
    return [("random_stratified", None), *([("group_split", group)] if group else []), *([("time_block_split", time)] if time else [])]


def split_sizes(df: DataFrame, dataset: str, split_type: str, group_field: str = "", split: str = "split") -> DataFrame:
    """One summary row: train/val/test sizes."""
    return df.agg(*[F.count_if(F.col(split) == s).alias(f"{s}_size") for s in SPLITS]).select(
        F.lit(dataset).alias("dataset"), F.lit(split_type).alias("split_type"), F.lit(group_field).alias("group_field"),
        "train_size", "val_size", "test_size")


def split_validity(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """ok / invalid_split_train_single_class / invalid_split_test_single_class."""
    agg = df.agg(
        F.count_distinct(F.when(F.col(split) == "train", F.col(label))).alias("train_classes"),
        F.count_distinct(F.when(F.col(split) == "test", F.col(label))).alias("test_classes"))
    return agg.select("train_classes", "test_classes",
                      F.when(F.col("train_classes") < 2, F.lit("invalid_split_train_single_class"))
                      .when(F.col("test_classes") < 2, F.lit("invalid_split_test_single_class"))
                      .otherwise(F.lit("ok")).alias("status"))


def class_cap_sample(df: DataFrame, label: str, id_cols: list[str], seed: int = 42, max_per_class: int = 10_000,
                     sample_size: int | None = 100_000, bits: int = HASH_BUCKET_BITS) -> DataFrame:
    """At most ``max_per_class`` rows per class, then at most ``sample_size`` rows overall.

    Rows are taken in md5(seed:id) order; a null label is a class.  The per-class cut is a bucketed
    rank cut (only the md5 bucket holding the cut position is sorted), so a
    class holding most of the table is never gathered into one task; the
    global cap is a top-k (TakeOrderedAndProject) over at most
    classes x max_per_class rows.
    """
    keyed = df.withColumn("_key", hash_key(seed, *id_cols)).withColumn("_bucket", hash_bucket(F.col("_key"), bits))
    capped = _first_per_class(keyed, label, "_bucket", ["_key", *id_cols], max_per_class)
    if sample_size:
        capped = capped.orderBy("_key", *id_cols).limit(sample_size)
    return capped.drop("_key", "_bucket")


def _first_per_class(df: DataFrame, cls: str, bucket: str, order: list, cap: int) -> DataFrame:
    def cuts(totals: DataFrame) -> DataFrame:
        return totals.select(cls, F.least(F.col("n_stratum"), F.lit(cap)).cast("long").alias("cap"))

    return assign_by_cuts(df, [cls], bucket, order, cuts, ["cap"], ["keep", "drop"], out="_keep").where(
        F.col("_keep") == "keep").drop("_keep")


def first_n_budget(df: DataFrame, cls: str, order_cols: list[str], cap: int, budget: int | None) -> DataFrame:
    """O2: per class the first ``cap`` rows in ``order_cols`` order (nulls last), then the first ``budget`` of those.

    A bucketed rank cut: only the bucket of each class that holds the cap position is sorted."""
    keys = order_cols if len(order_cols) > 1 else [*order_cols, *order_cols]
    order = [F.col(c).asc_nulls_last() for c in order_cols]
    kept = _first_per_class(order_bucket(df, keys), cls, "_bucket", order, cap).drop("_bucket")
    return kept.orderBy(*order).limit(budget) if budget else kept
