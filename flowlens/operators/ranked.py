"""Exact ranks and cuts without a single-task global sort (``ranked_cut``).

Ranking all rows of a big stratum with ``row_number() over (partition by
stratum order by key)`` puts the whole stratum into one task.  Here the
order key is first mapped to a coarse *bucket* that preserves the order
(the leading bits of an md5 key, or quantiles of a time column with ties cut
further by the id):

1. counts per (stratum, bucket) - a table of at most strata x buckets rows;
2. running offsets over that small table (window per stratum);
3. rows whose bucket lies entirely before/after a cut get their label from
   the offsets alone (a join, no sort);
4. only rows in a bucket that contains a cut are ranked, with
   ``row_number`` over (stratum, bucket) - a small slice of one stratum.

The number of buckets is a parameter and never changes the result: every
row gets the label that ``row_number`` over the whole stratum gives.  Null
strata are a stratum, null order values come last.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer, QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import checkpoint_dir

HASH_BUCKET_BITS = 8
TIME_BUCKETS = 64
TIE_BUCKETS = 64
BROADCAST_ROWS = 200_000  # the offsets table is broadcast up to this many rows, else joined by shuffle


def hash_key(seed: int, *ids: Column | str) -> Column:
    """Reproducible pseudo-random order key: md5('seed:id...') (same in DuckDB)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_bucket(key: Column, bits: int = HASH_BUCKET_BITS) -> Column:
    """Order-preserving bucket of an md5 hex key: its leading ``bits`` bits (a multiple of 4)."""
    digits = bits // 4
    if digits == 0:
        return F.lit(0)
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def as_number(df: DataFrame, column: str) -> Column:
    """An order column as a double: microseconds for timestamps, days for dates, a number's value; null for other
    types, whose values then share one bucket."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(column).cast("double")
    return F.col(column).cast("double") if isinstance(dtype, T.NumericType) else F.lit(None).cast("double")


def quantile_bucket(df: DataFrame, column: str, buckets: int = 1024, out: str = "_bucket") -> DataFrame:
    """Order-preserving bucket of a numeric column from approximate quantiles (skew-robust)."""
    if buckets <= 1:
        return df.withColumn(out, F.lit(0))
    tmp = f"{out}_src"
    qd = QuantileDiscretizer(numBuckets=buckets, inputCol=tmp, outputCol=out, relativeError=1e-3,
                             handleInvalid="keep")
    src = df.withColumn(tmp, as_number(df, column))
    model = qd.fit(src)
    return model.transform(src).withColumn(out, F.col(out).cast("int")).drop(tmp)


def order_bucket(df: DataFrame, order_cols: list[str], buckets: int = TIME_BUCKETS, ties: int = TIE_BUCKETS,
                 out: str = "_bucket") -> DataFrame:
    """Bucket that preserves the order of ``order_cols`` (a time or number, then a numeric id), nulls last.

    Time is cut at approximate quantiles; a value that fills a whole quantile gets a bucket of its own.
    Buckets of a single value, and that of the nulls, are cut further at quantiles of the id, so equal
    times don't meet in one task.  The cut points (at most 2 x buckets + ties numbers) pass the driver.
    """
    time_col, id_col = order_cols[0], order_cols[1]
    if not isinstance(df.schema[time_col].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return sampled_bucket(df, order_cols, buckets, out)
    src = df.withColumn("_t", as_number(df, time_col)).withColumn("_i", as_number(df, id_col))
    probs = [k / buckets for k in range(1, buckets)]
    id_probs = [k / ties for k in range(1, ties)]
    order = sorted({*probs, *id_probs}) or [0.5]
    whole = [F.percentile_approx(F.when(~F.isnan(c), F.col(c)), order, 1000).alias(c) for c in ("_t", "_i")]
    t_cuts, i_cuts = src.agg(*whole).first()
    t_cuts = [c for p, c in zip(order, t_cuts) if p in set(probs)] if t_cuts else []
    i_cuts = sorted({c for p, c in zip(order, i_cuts) if p in set(id_probs)}) if i_cuts else []
    hot = sorted({a for a, b in zip(t_cuts, t_cuts[1:]) if a == b})
    edges = sorted({*t_cuts, *hot, *[_next_up(h) for h in hot]})
    number = _bucket_no(src, "_t", edges, "_tb")
    number = _bucket_no(number, "_i", i_cuts, "_ib")
    null_t = F.col("_t").isNull() | F.isnan("_t")
    tied = F.col("_t").isin(*[float(h) for h in hot]) if hot else F.lit(False)
    base = F.when(null_t, F.lit(len(edges) + 1)).otherwise(F.col("_tb")).cast("long")
    sub = F.when(null_t | tied, F.col("_ib")).otherwise(0).cast("long")
    return number.withColumn(out, base * (ties + 2) + sub).drop("_t", "_i", "_tb", "_ib")


def sampled_bucket(df: DataFrame, order_cols: list[str], buckets: int, out: str, per_bucket: int = 32) -> DataFrame:
    """Bucket that preserves any order of ``order_cols``, nulls last: cut at quantiles of a sample of whole order keys.

    The sample is the buckets x ``per_bucket`` rows with the smallest hashes, a bounded top-k; it decides how even the buckets
    are, never the result.
    """
    key = F.struct(*[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")) for c in order_cols])
    sample = df.select(key.alias("key"), F.xxhash64(*order_cols).alias("h")).orderBy("h").limit(buckets * per_bucket)
    keys = [r["key"] for r in sample.orderBy("key").collect()]
    cuts = list(dict.fromkeys(keys[k * len(keys) // buckets] for k in range(1, buckets))) if keys else []
    if not cuts:
        return df.withColumn(out, F.lit(0).cast("long"))
    kinds = [df.schema[c].dataType for c in order_cols]
    known = F.array(*[F.struct(*[F.struct(F.lit(v["none"]).alias("none"), F.lit(v["value"]).cast(k).alias("value")) for v, k in zip(cut, kinds, strict=True)]) for cut in cuts])
    kind = "array<struct<" + ",".join(f"col{i + 1}:struct<none:boolean,value:{k.simpleString()}>" for i, k in enumerate(kinds)) + ">>"
    named = F.struct(*[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")).alias(f"col{i + 1}") for i, c in enumerate(order_cols)])
    return df.withColumn(out, F.size(F.filter(known.cast(kind), lambda cut: cut <= named)).cast("long"))


def _next_up(x: float) -> float:
    import math

    return math.nextafter(x, math.inf)


def _bucket_no(df: DataFrame, column: str, cuts: list[float], out: str) -> DataFrame:
    """Number of ``cuts`` at or below a value (binary search in the JVM); 0 for null."""
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    splits = [-float("inf"), *cuts, float("inf")]
    filled = df.withColumn(f"{out}_src", F.when(F.col(column).isNull() | F.isnan(column), F.lit(cuts[0])).otherwise(F.col(column)))
    return Bucketizer(splits=splits, inputCol=f"{out}_src", outputCol=out).transform(filled).drop(f"{out}_src")


def stratum_key(strata: list[str]) -> Column:
    """One join key for the strata columns that is never null and tells null from any text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in strata]
    return F.concat_ws("\u0001", *parts) if parts else F.lit("")


def bucket_offsets(df: DataFrame, strata: list[str], bucket: str) -> DataFrame:
    """(_stratum, strata, bucket, n_bucket, offset, n_stratum): running counts over the small bucket table."""
    counts = (df.groupBy(stratum_key(strata).alias("_stratum"), F.col(bucket))
              .agg(F.count(F.lit(1)).alias("n_bucket"), *[F.any_value(c).alias(c) for c in strata]))
    w = Window.partitionBy("_stratum")
    before = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (counts
            .withColumn("offset", F.coalesce(F.sum("n_bucket").over(before), F.lit(0)).cast("long"))
            .withColumn("n_stratum", F.sum("n_bucket").over(w).cast("long")))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows; else as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with 0, 1, 2, ... in the given total order, by range partitions: no task sees all rows.

    The range-partitioned rows are checkpointed, so a partition keeps its rows; the partitions' sizes, one row
    each, give the first number of each.
    """
    checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    first = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_place", place).join(F.broadcast(first), "_part").withColumn(
        out, F.col("_first") + F.col("_place")).drop("_part", "_place", "_first")


def assign_by_cuts(df: DataFrame, strata: list[str], bucket: str, order: list[str | Column], cuts,
                   cut_cols: list[str], labels: list[str], out: str = "split", only: str | None = None,
                   late: dict[str, Column] | None = None) -> DataFrame:
    """Label rows by their exact rank within the stratum; every input row is returned, or with ``only`` those of that
    label: buckets without it then leave in the join.  ``late`` are columns of ``order`` that only rows to be ranked get.

    ``cuts`` has one row per stratum with increasing cut positions
    ``cut_cols`` (counts) - or is a function that builds that table from the
    stratum totals ``(strata, n_stratum)``; rank < cut_1 -> labels[0],
    < cut_2 -> labels[1] ... else labels[-1].  ``order`` must make the order
    total (add an id).  A stratum without cuts gets labels[-1].

    The offsets table (strata x buckets rows) is written once to the shared
    checkpoint folder and broadcast if it is small, so rows are not shuffled
    on the stratum; the rows are then read twice: once for the buckets
    labelled by the join alone (map-only) and once for the buckets that
    contain a cut (shuffled and sorted, a small share of the rows).
    """
    checkpoint_dir(df.sparkSession)
    offsets = bucket_offsets(df, strata, bucket).checkpoint(eager=True)
    if callable(cuts):
        cuts = cuts(offsets.select("_stratum", *strata, "n_stratum").dropDuplicates(["_stratum"]).drop("_stratum"))
    cuts = cuts.withColumn("_stratum", stratum_key(strata)).select("_stratum", *cut_cols)
    offsets = offsets.select("_stratum", bucket, "n_bucket", "offset").join(cuts, "_stratum", "left").na.fill(0, cut_cols)
    lo = F.col("offset")
    hi = F.col("offset") + F.col("n_bucket")
    straddle = F.lit(False)
    for c in cut_cols:
        straddle = straddle | ((lo < F.col(c)) & (hi > F.col(c)))
    offsets = offsets.withColumn("_straddle", straddle)

    def label_of(pos: Column) -> Column:
        expr = None
        for c, lab in zip(cut_cols, labels):
            expr = F.when(pos < F.col(c), F.lit(lab)) if expr is None else expr.when(pos < F.col(c), F.lit(lab))
        return expr.otherwise(F.lit(labels[-1]))

    if only is not None:
        offsets = offsets.where(F.col("_straddle") | (label_of(F.col("offset")) == only))
    offsets = small_side(offsets)
    joined = df.withColumn("_stratum", stratum_key(strata)).join(offsets, on=["_stratum", bucket], how="inner")
    whole = joined.where(~F.col("_straddle")).withColumn(out, label_of(F.col("offset")))
    w = Window.partitionBy("_stratum", bucket).orderBy(*order)
    ranked = (joined.where(F.col("_straddle")).withColumns(late or {})
              .withColumn("_rank", F.col("offset") + F.row_number().over(w) - 1)
              .withColumn(out, label_of(F.col("_rank"))).drop("_rank", *(late or {})))
    kept = [c for c in df.columns if c != out]
    found = whole.unionByName(ranked if only is None else ranked.where(F.col(out) == only))
    return found.select(*kept, out)


def exact_rank(df: DataFrame, strata: list[str], bucket: str, order: list[str], out: str = "rank") -> DataFrame:
    """0-based row_number within each stratum, computed bucket by bucket."""
    offsets = bucket_offsets(df, strata, bucket).select("_stratum", bucket, "offset")
    w = Window.partitionBy("_stratum", bucket).orderBy(*order)
    return (df.withColumn("_stratum", stratum_key(strata)).join(offsets, on=["_stratum", bucket], how="inner")
            .withColumn(out, F.col("offset") + F.row_number().over(w) - 1).drop("offset", "_stratum"))
