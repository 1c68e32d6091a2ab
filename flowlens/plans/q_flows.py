"""Bidirectional-flow stand-in built from lineitem x orders, and F2-F5 queries.

Per order: ``fwd`` = lines with return flag R, ``bwd`` = the other lines;
packet length = quantity; inter-arrival time = days between consecutive ship
dates of the same side.  The builder only produces rows in the biflow
schema; the feature derivation itself is :func:`add_flow_metadata`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.operators.flow import add_flow_metadata
from flowlens.plans.registry import query, table
from flowlens.vocab import COMMON_CROSS_FEATURES

SIDES = ("fwd", "bwd")


def biflow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_tax",
        F.unix_date(F.col("l_shipdate").cast("date")).alias("day"))
    li = li.withColumn("side", F.when(F.col("l_returnflag") == "R", "fwd").otherwise("bwd"))
    w = Window.partitionBy("l_orderkey", "side").orderBy("day", "l_linenumber")
    li = li.withColumn("iat", (F.col("day") - F.lag("day").over(w)).cast("double"))
    aggs = [F.min("l_partkey").alias("prt_src"), F.max("l_suppkey").alias("prt_dst")]
    for s in SIDES:
        on = F.col("side") == s
        q = F.when(on, F.col("l_quantity"))
        i = F.when(on, F.col("iat"))
        aggs += [
            F.count_if(on).alias(f"{s}_num_pkts"),
            F.coalesce(F.sum(q), F.lit(0.0)).alias(f"{s}_num_bytes"),
            F.sum(q).alias(f"_{s}_q"), F.sum(q * q).alias(f"_{s}_q2"), F.count(q).alias(f"_{s}_qn"),
            F.min(q).alias(f"{s}_min_pkt_len"), F.max(q).alias(f"{s}_max_pkt_len"),
            F.sum(i).alias(f"_{s}_i"), F.sum(i * i).alias(f"_{s}_i2"), F.count(i).alias(f"_{s}_in"),
            F.min(i).alias(f"{s}_min_iat"), F.max(i).alias(f"{s}_max_iat"),
            F.count_if(on & (F.col("l_linestatus") == "O")).alias(f"{s}_num_psh_flags"),
            F.count_if(on & (F.col("l_tax") == 0)).alias(f"{s}_num_rst_flags"),
        ]
    flows = li.groupBy("l_orderkey").agg(*aggs)
    for s in SIDES:
        for stat, total, sq, n in (("pkt_len", f"_{s}_q", f"_{s}_q2", f"_{s}_qn"), ("iat", f"_{s}_i", f"_{s}_i2", f"_{s}_in")):
            mean = F.when(F.col(n) > 0, F.col(total) / F.col(n))
            flows = flows.withColumn(f"{s}_mean_{stat}", mean).withColumn(
                f"{s}_std_{stat}", F.when(F.col(n) > 0, F.sqrt(F.greatest(F.col(sq) / F.col(n) - mean * mean, F.lit(0.0)))))
        flows = flows.drop(f"_{s}_q", f"_{s}_q2", f"_{s}_qn", f"_{s}_i", f"_{s}_i2", f"_{s}_in")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("10.0."), F.col("o_custkey").cast("string")).alias("ip_src"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_attack"))
    return flows.join(orders, "l_orderkey").withColumn("proto", F.lit(6))


BIFLOW_SQL = """
WITH li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_tax,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS day,
         CASE WHEN l_returnflag = 'R' THEN 'fwd' ELSE 'bwd' END AS side FROM lineitem),
li2 AS (SELECT *, CAST(day - lag(day) OVER (PARTITION BY l_orderkey, side ORDER BY day, l_linenumber) AS DOUBLE) AS iat FROM li),
a AS (
  SELECT l_orderkey, min(l_partkey) AS prt_src, max(l_suppkey) AS prt_dst,
  {side_aggs}
  FROM li2 GROUP BY l_orderkey),
f AS (SELECT a.*, {side_stats} FROM a)
SELECT f.*, '10.0.' || CAST(o.o_custkey AS VARCHAR) AS ip_src, CAST(o.o_orderstatus = 'F' AS INTEGER) AS is_attack, 6 AS proto
FROM f JOIN orders o ON o.o_orderkey = f.l_orderkey
"""


def _side_aggs() -> str:
    parts = []
    for s in SIDES:
        q = f"CASE WHEN side = '{s}' THEN l_quantity END"
        i = f"CASE WHEN side = '{s}' THEN iat END"
        parts += [
            f"count(*) FILTER (WHERE side = '{s}') AS {s}_num_pkts", f"coalesce(sum({q}), 0.0) AS {s}_num_bytes",
            f"sum({q}) AS _{s}_q", f"sum({q} * {q}) AS _{s}_q2", f"count({q}) AS _{s}_qn",
            f"min({q}) AS {s}_min_pkt_len", f"max({q}) AS {s}_max_pkt_len",
            f"sum({i}) AS _{s}_i", f"sum({i} * {i}) AS _{s}_i2", f"count({i}) AS _{s}_in",
            f"min({i}) AS {s}_min_iat", f"max({i}) AS {s}_max_iat",
            f"count(*) FILTER (WHERE side = '{s}' AND l_linestatus = 'O') AS {s}_num_psh_flags",
            f"count(*) FILTER (WHERE side = '{s}' AND l_tax = 0) AS {s}_num_rst_flags"]
    return ",\n  ".join(parts)


def _side_stats() -> str:
    parts = []
    for s in SIDES:
        for stat, t, sq, n in (("pkt_len", f"_{s}_q", f"_{s}_q2", f"_{s}_qn"), ("iat", f"_{s}_i", f"_{s}_i2", f"_{s}_in")):
            mean = f"(CASE WHEN {n} > 0 THEN {t} / {n} END)"
            parts += [f"{mean} AS {s}_mean_{stat}",
                      f"CASE WHEN {n} > 0 THEN sqrt(greatest({sq} / {n} - {mean} * {mean}, 0.0)) END AS {s}_std_{stat}"]
    return ", ".join(parts)


BIFLOW = BIFLOW_SQL.format(side_aggs=_side_aggs(), side_stats=_side_stats())


def _pair_mean_sql(a: str, b: str) -> str:
    n = f"((CASE WHEN {a} IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN {b} IS NOT NULL THEN 1 ELSE 0 END))"
    return f"CASE WHEN {n} > 0 THEN (coalesce({a}, 0.0) + coalesce({b}, 0.0)) / {n} END"


def _finite(x: str) -> str:
    return f"CASE WHEN isnan({x}) OR abs({x}) = 'inf'::DOUBLE THEN NULL ELSE {x} END"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) IS NULL OR ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END"


def normalized_features_sql(src: str) -> str:
    pc = "(coalesce(CAST(fwd_num_pkts AS DOUBLE), 0.0) + coalesce(CAST(bwd_num_pkts AS DOUBLE), 0.0))"
    bs = "(coalesce(fwd_num_bytes, 0.0) + coalesce(bwd_num_bytes, 0.0))"
    bm = _pair_mean_sql("fwd_mean_pkt_len", "bwd_mean_pkt_len")
    bsd = _pair_mean_sql("fwd_std_pkt_len", "bwd_std_pkt_len")
    im = _pair_mean_sql("fwd_mean_iat", "bwd_mean_iat")
    isd = _pair_mean_sql("fwd_std_iat", "bwd_std_iat")
    imax = "greatest(fwd_max_iat, bwd_max_iat)"
    feats = {
        "packet_count": pc, "byte_sum": bs, "byte_mean": bm, "byte_std": bsd,
        "byte_min": "least(fwd_min_pkt_len, bwd_min_pkt_len)", "byte_max": "greatest(fwd_max_pkt_len, bwd_max_pkt_len)",
        "duration": imax, "iat_mean": im, "iat_std": isd, "iat_min": "least(fwd_min_iat, bwd_min_iat)", "iat_max": imax,
        "bytes_per_second": _div(bs, imax), "packets_per_second": _div(pc, imax), "burstiness": _div(bsd, bm),
    }
    cols = ", ".join(f"{_finite(feats[c])} AS {c}" for c in COMMON_CROSS_FEATURES)
    return f"SELECT l_orderkey, is_attack, {cols} FROM ({src})"


@query("biflow_features", normalized_features_sql(BIFLOW))
def biflow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 common metadata features derived from fwd/bwd flow counters."""
    flows = add_flow_metadata(biflow_table(spark, sf_dir), mode="normalized")
    return flows.select("l_orderkey", "is_attack", *COMMON_CROSS_FEATURES)


def common_features_sql(src: str) -> str:
    pc = "(coalesce(CAST(fwd_num_pkts AS DOUBLE), 0.0) + coalesce(CAST(bwd_num_pkts AS DOUBLE), 0.0))"
    bs = "(coalesce(fwd_num_bytes, 0.0) + coalesce(bwd_num_bytes, 0.0))"
    bm = _pair_mean_sql("fwd_mean_pkt_len", "bwd_mean_pkt_len")
    bsd = _pair_mean_sql("fwd_std_pkt_len", "bwd_std_pkt_len")
    dur = "coalesce(greatest(fwd_max_iat, bwd_max_iat), 0.0)"
    zero = lambda x: f"coalesce({_finite(x)}, 0.0)"
    feats = {
        "packet_count": pc, "byte_sum": bs, "byte_mean": bm, "byte_std": bsd,
        "byte_min": "least(fwd_min_pkt_len, bwd_min_pkt_len)", "byte_max": "greatest(fwd_max_pkt_len, bwd_max_pkt_len)",
        "duration": dur, "iat_mean": _pair_mean_sql("fwd_mean_iat", "bwd_mean_iat"),
        "iat_std": _pair_mean_sql("fwd_std_iat", "bwd_std_iat"), "iat_min": "least(fwd_min_iat, bwd_min_iat)",
        "iat_max": "greatest(fwd_max_iat, bwd_max_iat)",
        "bytes_per_second": zero(_div(bs, dur)), "packets_per_second": zero(_div(pc, dur)), "burstiness": zero(_div(bsd, bm)),
    }
    cols = ", ".join(f"{feats[c]} AS {c}" for c in COMMON_CROSS_FEATURES)
    return f"SELECT l_orderkey, is_attack, {cols} FROM ({src})"


@query("biflow_common_features", common_features_sql(BIFLOW))
def biflow_common_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the earlier cleaning-time variant (always recomputed, ratios null/inf -> 0)."""
    flows = add_flow_metadata(biflow_table(spark, sf_dir), mode="common")
    return flows.select("l_orderkey", "is_attack", *COMMON_CROSS_FEATURES)
