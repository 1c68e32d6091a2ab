"""Sampling and split queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.splits import (
    class_cap_sample, find_group_field, first_n_budget, group_split, random_stratified_split, split_sizes,
    split_validity, time_block_split,
)
from flowlens.plans.registry import query, table

LI_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # unique row id of lineitem

STRATIFIED_SQL = """
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
                  md5(concat_ws(':', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS key FROM lineitem),
c AS (SELECT l_returnflag, count(*) AS n_c FROM k GROUP BY 1),
a1 AS (SELECT *, CAST(sum(n_c) OVER () AS BIGINT) AS n FROM c),
b1 AS (SELECT *, CAST(n - ceil(CAST(0.3 AS DOUBLE) * n) AS BIGINT) AS target FROM a1),
d1 AS (SELECT *, (target * n_c) // n AS base, (target * n_c) % n AS frac FROM b1),
r1 AS (SELECT *, target - sum(base) OVER () AS extra,
              row_number() OVER (ORDER BY frac DESC, l_returnflag) AS pos FROM d1),
s1 AS (SELECT l_returnflag, n_c, base + CASE WHEN pos <= extra THEN 1 ELSE 0 END AS train_c FROM r1),
h AS (SELECT *, n_c - train_c AS held_c FROM s1),
a2 AS (SELECT *, CAST(sum(held_c) OVER () AS BIGINT) AS nh FROM h),
b2 AS (SELECT *, CAST(nh - ceil(CAST(0.5 AS DOUBLE) * nh) AS BIGINT) AS target FROM a2),
d2 AS (SELECT *, CASE WHEN nh > 0 THEN (target * held_c) // nh ELSE 0 END AS base,
                 CASE WHEN nh > 0 THEN (target * held_c) % nh ELSE 0 END AS frac FROM b2),
r2 AS (SELECT *, target - sum(base) OVER () AS extra,
              row_number() OVER (ORDER BY frac DESC, l_returnflag) AS pos FROM d2),
cuts AS (SELECT l_returnflag, train_c AS cut_train,
                train_c + base + CASE WHEN pos <= extra THEN 1 ELSE 0 END AS cut_val FROM r2),
rk AS (SELECT k.*, row_number() OVER (PARTITION BY l_returnflag ORDER BY key, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS r FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
       CASE WHEN r < cut_train THEN 'train' WHEN r < cut_val THEN 'val' ELSE 'test' END AS split
FROM rk JOIN cuts USING (l_returnflag)
"""

GROUP_SQL = """
WITH g AS (SELECT DISTINCT coalesce(CAST(l_suppkey AS VARCHAR), '<NA>') AS grp FROM lineitem),
gk AS (SELECT grp, md5(concat_ws(':', '42', grp)) AS key FROM g),
n AS (SELECT count(*) AS g FROM gk),
c AS (SELECT CAST(floor(CAST(0.7 AS DOUBLE) * g) AS BIGINT) AS cut_train,
             CAST(floor(CAST(0.7 AS DOUBLE) * g) + floor(CAST(0.5 AS DOUBLE) * (g - floor(CAST(0.7 AS DOUBLE) * g))) AS BIGINT) AS cut_val
      FROM n),
r AS (SELECT grp, row_number() OVER (ORDER BY key, grp) - 1 AS r FROM gk),
lab AS (SELECT grp, CASE WHEN r < cut_train THEN 'train' WHEN r < cut_val THEN 'val' ELSE 'test' END AS split FROM r, c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, split
FROM lineitem JOIN lab ON coalesce(CAST(l_suppkey AS VARCHAR), '<NA>') = grp
"""

TIME_SQL = """
WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM events)
SELECT event_id, event_type,
  CASE WHEN r < floor(CAST(0.7 AS DOUBLE) * n) THEN 'train'
       WHEN r < floor(CAST(0.7 AS DOUBLE) * n) + floor(CAST(0.15 AS DOUBLE) * n) THEN 'val' ELSE 'test' END AS split
FROM r
"""


def _stratified(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*LI_ID, "l_returnflag", "l_linestatus")
    return random_stratified_split(li, "l_returnflag", LI_ID, seed=42)


def _grouped(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*LI_ID, "l_linestatus")
    return group_split(li, "l_suppkey", seed=42)


def _time_block(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return time_block_split(ev, ["ts", "event_id"]).drop("ts")


@query("stratified_split", STRATIFIED_SQL)
def stratified_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70/15/15 stratified split of lineitem by return flag (md5-ranked, bucketed cuts)."""
    return _stratified(spark, sf_dir)


@query("group_split", GROUP_SQL)
def group_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier groups never shared between train, val and test."""
    return _grouped(spark, sf_dir)


@query("time_block_split", TIME_SQL)
def time_block_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 70 % / next 15 % / last 15 % of events in time order."""
    return _time_block(spark, sf_dir)


def _sizes_sql(src: str, dataset: str, split_type: str, group_field: str) -> str:
    return (f"SELECT '{dataset}' AS dataset, '{split_type}' AS split_type, '{group_field}' AS group_field, "
            f"count(*) FILTER (WHERE split = 'train') AS train_size, count(*) FILTER (WHERE split = 'val') AS val_size, "
            f"count(*) FILTER (WHERE split = 'test') AS test_size FROM ({src})")


@query("split_sizes", " UNION ALL ".join([
    _sizes_sql(STRATIFIED_SQL, "lineitem", "random_stratified", ""),
    _sizes_sql(GROUP_SQL, "lineitem", "group_split", "l_suppkey"),
    _sizes_sql(TIME_SQL, "events", "time_block_split", "ts"),
    "SELECT 'events' AS dataset, 'group_split_not_available' AS split_type, '' AS group_field, "
    "CAST(0 AS BIGINT) AS train_size, CAST(0 AS BIGINT) AS val_size, CAST(0 AS BIGINT) AS test_size"]))
def split_sizes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split summary, including the row for a table without a group field."""
    parts = [split_sizes(_stratified(spark, sf_dir), "lineitem", "random_stratified"),
             split_sizes(_grouped(spark, sf_dir), "lineitem", "group_split", "l_suppkey"),
             split_sizes(_time_block(spark, sf_dir), "events", "time_block_split", "ts")]
    events = table(spark, sf_dir, "events")
    if find_group_field(events) is None:
        parts.append(spark.range(1).select(
            F.lit("events").alias("dataset"), F.lit("group_split_not_available").alias("split_type"),
            F.lit("").alias("group_field"), *[F.lit(0).cast("long").alias(f"{s}_size") for s in ("train", "val", "test")]))
    return reduce(DataFrame.unionByName, parts)


def _validity_sql(src: str, dataset: str, split_type: str, label: str) -> str:
    return f"""SELECT '{dataset}' AS dataset, '{split_type}' AS split_type, train_classes, test_classes,
  CASE WHEN train_classes < 2 THEN 'invalid_split_train_single_class'
       WHEN test_classes < 2 THEN 'invalid_split_test_single_class' ELSE 'ok' END AS status
FROM (SELECT count(DISTINCT {label}) FILTER (WHERE split = 'train') AS train_classes,
             count(DISTINCT {label}) FILTER (WHERE split = 'test') AS test_classes FROM ({src}))"""


@query("split_validity", " UNION ALL ".join([
    _validity_sql(STRATIFIED_SQL, "lineitem", "random_stratified", "l_linestatus"),
    _validity_sql(GROUP_SQL, "lineitem", "group_split", "l_linestatus"),
    _validity_sql(TIME_SQL, "events", "time_block_split", "event_type")]))
def split_validity_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each split needs two classes in train and in test."""
    parts = [(_stratified(spark, sf_dir), "lineitem", "random_stratified", "l_linestatus"),
             (_grouped(spark, sf_dir), "lineitem", "group_split", "l_linestatus"),
             (_time_block(spark, sf_dir), "events", "time_block_split", "event_type")]
    return reduce(DataFrame.unionByName, [
        split_validity(df, label).select(F.lit(d).alias("dataset"), F.lit(s).alias("split_type"), "train_classes",
                                         "test_classes", "status") for df, d, s, label in parts])


@query("class_cap_sample", """
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, md5(concat_ws(':', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS key FROM lineitem),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY key, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM k)
      WHERE r <= 10000)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM c ORDER BY key, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25000
""")
def class_cap_sample_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class cap of 10,000 then a global cap of 25,000, md5 order (sampling operator: the cap is the feature)."""
    li = table(spark, sf_dir, "lineitem").select(*LI_ID, "l_returnflag")
    return class_cap_sample(li, "l_returnflag", LI_ID, seed=42, max_per_class=10_000, sample_size=25_000)


@query("first_n_budget", """
SELECT event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events)
WHERE r <= 1000 ORDER BY ts, event_id LIMIT 4000
""")
def first_n_budget_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: first 1,000 events per type in time order, then the first 4,000 of those."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return first_n_budget(ev, "event_type", ["ts", "event_id"], cap=1000, budget=4000).drop("ts")


@query("first_n_by_file", """
SELECT event_id, log FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY log NULLS LAST, event_id) AS r FROM (
    SELECT *, CASE WHEN user_id % 17 <> 0 THEN 'log' || CAST(user_id % 17 AS VARCHAR) END AS log FROM events))
WHERE r <= 700
""")
def first_n_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: first 700 events per type in (file name, event) order, an order that starts with a text."""
    user = F.col("user_id") % 17
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(user != 0, F.concat(F.lit("log"), user.cast("string"))).alias("log"))
    return first_n_budget(ev, "event_type", ["log", "event_id"], cap=700, budget=None).drop("event_type")


# -- the same operators with many rank buckets, null labels, null times and whole days of equal times --------------
NULLED_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS mode,
  CASE WHEN l_linenumber <> 5 THEN CAST(l_shipdate AS DATE) END AS day FROM lineitem"""


def _nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a label and a day that are null in some rows."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LI_ID, F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("mode"),
                     F.when(F.col("l_linenumber") != 5, F.col("l_shipdate").cast("date")).alias("day"))


@query("time_block_split_buckets", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY day NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS r,
                  count(*) OVER () AS n FROM ({NULLED_SQL}))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN r < floor(CAST(0.7 AS DOUBLE) * n) THEN 'train'
       WHEN r < floor(CAST(0.7 AS DOUBLE) * n) + floor(CAST(0.15 AS DOUBLE) * n) THEN 'val' ELSE 'test' END AS split
FROM r""")
def time_block_split_buckets_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 on days: ties split by id, null days last, no row lost."""
    return time_block_split(_nulled(spark, sf_dir), ["day", *LI_ID], buckets=64).drop("day", "mode")


@query("stratified_split_buckets", STRATIFIED_SQL.replace("l_returnflag, l_linestatus,", "mode,").replace(
    "l_returnflag", "mode").replace(", l_linestatus", "").replace("FROM lineitem)", f"FROM ({NULLED_SQL}))").replace(
    "JOIN cuts USING (mode)", "JOIN cuts ON rk.mode IS NOT DISTINCT FROM cuts.mode").replace(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, mode,\n       CASE", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rk.mode,\n       CASE").replace(
    "ORDER BY frac DESC, mode)", "ORDER BY frac DESC, mode NULLS LAST)"))
def stratified_split_buckets_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 with a null class and 256 rank buckets for each class."""
    return random_stratified_split(_nulled(spark, sf_dir).drop("day"), "mode", LI_ID, seed=42, bits=8)


@query("class_cap_buckets", f"""
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, mode, md5(concat_ws(':', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS key FROM ({NULLED_SQL}))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, mode FROM (
  SELECT *, row_number() OVER (PARTITION BY mode ORDER BY key, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM k)
WHERE r <= 2000""")
def class_cap_buckets_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 with a null class and 256 rank buckets: at most 2,000 rows of each class (the cap is the feature)."""
    return class_cap_sample(_nulled(spark, sf_dir).drop("day"), "mode", LI_ID, seed=42, max_per_class=2000,
                            sample_size=None, bits=8)
