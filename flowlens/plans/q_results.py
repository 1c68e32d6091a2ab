"""Experiment-result queries (A1, A3-A7, E6/E12) over a metric-run table.

The run table is computed, not given: three threshold rules ("models") are
evaluated on lineitem (y = return flag R) on the test part of a stratified
split for each of the five seeds and on a time-block split, with the
library's own split and metric operators.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.metrics import average_precision, classification_metrics
from flowlens.operators.ranked import hash_bucket, hash_key
from flowlens.operators.results import argmax_row, best_by, delta_vs_baseline, pivot_hue, seed_stability, top_k
from flowlens.operators.splits import random_stratified_split, time_block_split
from flowlens.plans.registry import query, table
from flowlens.session import checkpoint_dir, scratch_path
from flowlens.sources.sinks import write_table
from flowlens.vocab import SEEDS

LI_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # unique row id of lineitem
MODELS = (("discount_rule", "l_discount", 0.05), ("quantity_rule", "l_quantity", 25.0), ("tax_rule", "l_tax", 0.04))
RUN_KEYS = ["split_type", "seed", "model"]
RUN_COLUMNS = ["dataset", "view_role", "task", "model", "split_type", "seed", "status", "n_test", "accuracy",
               "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "pr_auc"]


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LI_ID, "l_shipdate", "l_discount", "l_quantity", "l_tax",
                     (F.col("l_returnflag") == "R").cast("int").alias("y"))


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_dir(spark)
    base = _base(spark, sf_dir)
    # a row's id is hashed once per seed, for the rank buckets of all passes; the rows are stored with them
    path = scratch_path(spark, f"runs/{uuid.uuid4().hex}")
    write_table(base.withColumns({f"_b{s}": hash_bucket(hash_key(s, *LI_ID)) for s in SEEDS}), path)
    base = spark.read.parquet(path)
    tests = [random_stratified_split(base, "y", LI_ID, seed=s, only="test", bucket=f"_b{s}")
             .select("*", F.lit("random_stratified").alias("split_type"), F.lit(s).alias("seed")) for s in SEEDS]
    tests.append(time_block_split(base, ["l_shipdate", *LI_ID], only="test")
                 .select("*", F.lit("time_block_split").alias("split_type"), F.lit(42).alias("seed")))
    # equal test rows of a run are counted, so a row is read once for all models and metrics; the counts are stored
    values = ["split_type", "seed", "y", *[c for _, c, _ in MODELS]]
    test = reduce(DataFrame.unionByName, [t.groupBy(*values).agg(F.count(F.lit(1)).alias("times")) for t in tests]).checkpoint(eager=True)
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(c) >= t).cast("int").alias("pred"),
                                          F.col(c).cast("double").alias("score")) for m, c, t in MODELS]))
    preds = test.select("split_type", "seed", "y", "times", models.alias("m")).select("split_type", "seed", "y", "times", "m.*")
    metrics = classification_metrics(preds, RUN_KEYS, times="times").join(average_precision(preds, RUN_KEYS, times="times"), RUN_KEYS, "left")
    return metrics.select(
        F.lit("lineitem").alias("dataset"), F.lit("strict").alias("view_role"), F.lit("binary").alias("task"),
        "model", "split_type", "seed", F.lit("ok").alias("status"), F.col("n").alias("n_test"), "accuracy",
        "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "pr_auc")


# --- oracle ----------------------------------------------------------------------------
def _alloc_sql(src: str, count: str, target: str) -> str:
    """Largest-remainder allocation of ``target`` over the classes of ``src`` (columns y, <count>)."""
    return f"""SELECT y, {count}, base + CASE WHEN pos <= extra THEN 1 ELSE 0 END AS alloc FROM (
  SELECT *, target - sum(base) OVER () AS extra, row_number() OVER (ORDER BY frac DESC, y) AS pos FROM (
    SELECT *, CASE WHEN tot > 0 THEN (target * {count}) // tot ELSE 0 END AS base,
              CASE WHEN tot > 0 THEN (target * {count}) % tot ELSE 0 END AS frac FROM (
      SELECT *, CAST({target} AS BIGINT) AS target FROM (
        SELECT y, {count}, CAST(sum({count}) OVER () AS BIGINT) AS tot FROM ({src})))))"""


def _strat_test_sql(seed: int) -> str:
    """Test part (last 15 %) of the 70/15/15 stratified split for one seed."""
    train = _alloc_sql("SELECT y, count(*) AS n_c FROM base GROUP BY y", "n_c", "tot - ceil(CAST(0.3 AS DOUBLE) * tot)")
    val = _alloc_sql(f"SELECT y, n_c - alloc AS held FROM ({train})", "held", "tot - ceil(CAST(0.5 AS DOUBLE) * tot)")
    return f"""SELECT k.* EXCLUDE (r), 'random_stratified' AS split_type, {seed} AS seed FROM (
  SELECT b.*, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', '{seed}', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
         l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS r FROM base b) k
JOIN (SELECT t.y, t.alloc AS cut_train, t.alloc + v.alloc AS cut_val FROM ({train}) t JOIN ({val}) v USING (y)) c USING (y)
WHERE r >= cut_val"""


def _runs_sql() -> str:
    strat = " UNION ALL ".join(f"SELECT * FROM ({_strat_test_sql(s)})" for s in SEEDS)
    models = " UNION ALL ".join(
        f"SELECT split_type, seed, y, '{m}' AS model, CAST({c} >= {t} AS INTEGER) AS pred, CAST({c} AS DOUBLE) AS score FROM test"
        for m, c, t in MODELS)
    return f"""WITH base AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_discount, l_quantity, l_tax,
                  CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
tb AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS r, count(*) OVER () AS n FROM base),
test AS ({strat} UNION ALL
  SELECT * EXCLUDE (r, n), 'time_block_split' AS split_type, 42 AS seed FROM tb
  WHERE r >= floor(CAST(0.7 AS DOUBLE) * n) + floor(CAST(0.15 AS DOUBLE) * n)),
p AS ({models}),
conf AS (SELECT split_type, seed, model, y, pred, count(*) AS n FROM p GROUP BY ALL),
cls AS (SELECT split_type, seed, model, class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
  SELECT split_type, seed, model, CAST(y AS VARCHAR) AS class, n AS support, 0 AS predicted,
         CASE WHEN y = pred THEN n ELSE 0 END AS tp FROM conf
  UNION ALL SELECT split_type, seed, model, CAST(pred AS VARCHAR), 0, n, 0 FROM conf) GROUP BY ALL),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM cls),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pm),
mt AS (SELECT split_type, seed, model, CAST(sum(support) AS BIGINT) AS n_test, round(sum(tp) / sum(support), 9) AS accuracy,
  round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
  round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM pf GROUP BY ALL),
sc AS (SELECT split_type, seed, model, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
       FROM p GROUP BY ALL),
rt AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_before, coalesce(sum(neg) OVER w, 0) AS neg_before FROM sc
       WINDOW w AS (PARTITION BY split_type, seed, model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ap AS (SELECT split_type, seed, model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(
  pos * ((pos_before + pos) / (pos_before + pos + neg_before + neg))) / sum(pos), 9) END AS pr_auc FROM rt GROUP BY ALL),
runs AS (SELECT 'lineitem' AS dataset, 'strict' AS view_role, 'binary' AS task, model, split_type, seed, 'ok' AS status,
  n_test, accuracy, macro_precision, macro_recall, macro_f1, weighted_f1, pr_auc FROM mt LEFT JOIN ap USING (split_type, seed, model))"""


RUNS_SQL = _runs_sql()


@query("run_metrics", RUNS_SQL + "\nSELECT * FROM runs")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows of a small experiment grid (3 rule models x 5 seeds + time block)."""
    return run_table(spark, sf_dir)


@query("seed_stability", RUNS_SQL + """
SELECT model, round(avg(macro_f1), 9) AS macro_f1_mean, round(stddev_samp(macro_f1), 9) AS macro_f1_std,
  round(avg(weighted_f1), 9) AS weighted_f1_mean, round(stddev_samp(weighted_f1), 9) AS weighted_f1_std,
  round(avg(pr_auc), 9) AS pr_auc_mean, round(stddev_samp(pr_auc), 9) AS pr_auc_std, count(macro_f1) AS n_runs
FROM runs WHERE status = 'ok' AND split_type = 'random_stratified' GROUP BY model""")
def seed_stability_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample std over the five seeds."""
    runs = run_table(spark, sf_dir).where(F.col("split_type") == "random_stratified")
    return seed_stability(runs, ["model"])


@query("best_by", RUNS_SQL + """
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY dataset, split_type, seed
  ORDER BY macro_f1 DESC NULLS LAST, model) AS rk FROM runs WHERE status = 'ok') WHERE rk = 1""")
def best_by_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: best model row per (dataset, split type, seed) - the whole row, ties by model name."""
    return best_by(run_table(spark, sf_dir), ["dataset", "split_type", "seed"])


@query("argmax_model", RUNS_SQL + """
SELECT dataset, split_type, arg_min(model, (-macro_f1, model)) AS best_model, max(macro_f1) AS best_macro_f1
FROM runs WHERE status = 'ok' GROUP BY dataset, split_type""")
def argmax_model_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: best model over all seeds per (dataset, split type)."""
    return argmax_row(run_table(spark, sf_dir), ["dataset", "split_type"])


@query("topk_runs", RUNS_SQL + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY macro_f1 DESC NULLS LAST, seed) AS rank
FROM runs WHERE split_type = 'random_stratified') WHERE rank <= 2""")
def topk_runs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: top-2 seeds per model (a top-k report)."""
    runs = run_table(spark, sf_dir).where(F.col("split_type") == "random_stratified")
    return top_k(runs, ["model"], "macro_f1", 2, tiebreak="seed")


@query("delta_vs_baseline", RUNS_SQL + """
SELECT *, macro_f1 - max(CASE WHEN split_type = 'random_stratified' THEN macro_f1 END)
  OVER (PARTITION BY dataset, model) AS macro_f1_delta_vs_random_stratified
FROM runs WHERE seed = 42""")
def delta_vs_baseline_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 of each split type minus the random stratified one (seed 42)."""
    runs = run_table(spark, sf_dir).where(F.col("seed") == 42)
    return delta_vs_baseline(runs, ["dataset", "model"], "split_type", "random_stratified")


@query("pivot_hue", RUNS_SQL + """
SELECT model, max(macro_f1) FILTER (WHERE split_type = 'random_stratified') AS random_stratified,
  max(macro_f1) FILTER (WHERE split_type = 'time_block_split') AS time_block_split
FROM runs WHERE seed = 42 GROUP BY model""")
def pivot_hue_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model x split type table of macro F1 (seed 42)."""
    runs = run_table(spark, sf_dir).where(F.col("seed") == 42)
    return pivot_hue(runs, "model", "split_type", "macro_f1", ["random_stratified", "time_block_split"])
