"""Metric queries on prediction tables derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.metrics import average_precision, binary_metrics, classification_metrics, per_class_metrics, roc_auc
from flowlens.plans.registry import query, table


def doc_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in predictions: targets quality and toxic of ``labels``; score = n_chars,
    pred = n_chars >= 1500 (a threshold rule)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels")
    joined = lab.join(docs, "doc_id")
    runs = F.explode(F.array(F.struct(F.lit("quality").alias("run"), F.col("quality").alias("y")),
                             F.struct(F.lit("toxic").alias("run"), F.col("toxic").alias("y"))))
    return joined.select("doc_id", "n_chars", runs.alias("r")).select(
        F.col("r.run").alias("run"), F.col("r.y").cast("int").alias("y"),
        F.when(F.col("n_chars") >= 1500, 1).otherwise(0).alias("pred"), F.col("n_chars").cast("double").alias("score"))


def lineitem_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in predictions over lineitem: y = return flag, pred from a discount rule, score = discount."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("lineitem").alias("run"), F.col("l_returnflag").alias("y"),
        F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R").alias("pred"),
        F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y_bin"))


DOC_PRED_SQL = """SELECT run, y, CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END AS pred, CAST(n_chars AS DOUBLE) AS score
FROM (SELECT d.n_chars, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))
CROSS JOIN LATERAL (VALUES ('quality', quality), ('toxic', toxic)) v(run, y)"""
LI_PRED_SQL = """SELECT 'lineitem' AS run, l_returnflag AS y,
  CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END AS pred,
  l_discount AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_bin FROM lineitem"""


def _class_sql(pred_sql: str) -> str:
    return f"""WITH p AS ({pred_sql}),
conf AS (SELECT run, y, pred, count(*) AS n FROM p GROUP BY ALL),
cls AS (SELECT run, class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support,
               CAST(sum(predicted) AS BIGINT) AS predicted FROM (
  SELECT run, CAST(y AS VARCHAR) AS class, n AS support, 0 AS predicted, CASE WHEN y = pred THEN n ELSE 0 END AS tp FROM conf
  UNION ALL SELECT run, CAST(pred AS VARCHAR), 0, n, 0 FROM conf) GROUP BY ALL),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM cls),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)"""


def _metrics_sql(pred_sql: str) -> str:
    return _class_sql(pred_sql) + """
SELECT run, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 9) AS accuracy,
  round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
  round(sum(f1 * support) / sum(support), 9) AS weighted_f1
FROM f GROUP BY run"""


def _auc_sql(pred_sql: str, y: str = "y") -> str:
    return f"""WITH p AS ({pred_sql}),
sc AS (SELECT run, score, count(*) FILTER (WHERE {y} = 1) AS pos, count(*) FILTER (WHERE {y} <> 1) AS neg
       FROM p WHERE score IS NOT NULL GROUP BY ALL),
rt AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS neg_before FROM sc)
SELECT run, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
  CAST(CAST(sum(CAST(pos AS DECIMAL(20,0)) * CAST(2 * neg_before + neg AS DECIMAL(20,0))) AS VARCHAR) AS DOUBLE)
  / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS roc_auc
FROM rt GROUP BY run"""


def _ap_sql(pred_sql: str, y: str = "y") -> str:
    return f"""WITH p AS ({pred_sql}),
sc AS (SELECT run, score, count(*) FILTER (WHERE {y} = 1) AS pos, count(*) FILTER (WHERE {y} <> 1) AS neg
       FROM p WHERE score IS NOT NULL GROUP BY ALL),
rt AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_before, coalesce(sum(neg) OVER w, 0) AS neg_before FROM sc
       WINDOW w AS (PARTITION BY run ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(CASE WHEN pos_before + pos + neg_before + neg > 0
  THEN pos * ((pos_before + pos) / (pos_before + pos + neg_before + neg)) ELSE 0.0 END) / sum(pos), 9) END AS pr_auc
FROM rt GROUP BY run"""


@query("binary_metrics", f"""
SELECT m.*, a.roc_auc, b.pr_auc FROM ({_metrics_sql(DOC_PRED_SQL)}) m
LEFT JOIN ({_auc_sql(DOC_PRED_SQL)}) a USING (run) LEFT JOIN ({_ap_sql(DOC_PRED_SQL)}) b USING (run)
""")
def binary_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, macro/weighted P/R/F1, ROC-AUC and PR-AUC for two label targets."""
    return binary_metrics(doc_predictions(spark, sf_dir), ["run"])


@query("multiclass_metrics", _metrics_sql(LI_PRED_SQL))
def multiclass_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 multiclass: classes are the union of true and predicted labels."""
    return classification_metrics(lineitem_predictions(spark, sf_dir), ["run"])


@query("per_class_metrics", _class_sql(f"{DOC_PRED_SQL} UNION ALL SELECT run, y, pred, score FROM ({LI_PRED_SQL})")
       .replace("WITH p AS (SELECT run, y,", "WITH p AS (SELECT run, CAST(y AS VARCHAR) AS y,", 0) + """
SELECT run, class, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f""")
def per_class_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class precision, recall, F1 and support."""
    docs = doc_predictions(spark, sf_dir).select("run", F.col("y").cast("string").alias("y"),
                                                 F.col("pred").cast("string").alias("pred"))
    li = lineitem_predictions(spark, sf_dir).select("run", "y", "pred")
    cls = per_class_metrics(docs.unionByName(li), ["run"])
    return cls.select("run", "class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("roc_auc", f"""{_auc_sql(DOC_PRED_SQL)} UNION ALL
SELECT * FROM ({_auc_sql(LI_PRED_SQL, 'y_bin')})""")
def roc_auc_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-aware ROC-AUC (n_chars and discount scores have many ties)."""
    li = lineitem_predictions(spark, sf_dir).select("run", F.col("y_bin").alias("y"), "score")
    return roc_auc(doc_predictions(spark, sf_dir), ["run"]).unionByName(roc_auc(li, ["run"]))


@query("avg_precision", f"""{_ap_sql(DOC_PRED_SQL)} UNION ALL
SELECT * FROM ({_ap_sql(LI_PRED_SQL, 'y_bin')})""")
def avg_precision_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision as the step sum over distinct scores."""
    li = lineitem_predictions(spark, sf_dir).select("run", F.col("y_bin").alias("y"), "score")
    return average_precision(doc_predictions(spark, sf_dir), ["run"]).unionByName(average_precision(li, ["run"]))
