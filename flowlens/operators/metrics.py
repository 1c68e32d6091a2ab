"""Classification metrics from a prediction table.

Input: ``(run keys..., y, pred[, score])``, or equal rows once with their number in
a column ``times``.  Every metric is a grouped aggregate, so the metrics of any number
of runs come from one job.

* accuracy, macro precision/recall/F1, weighted F1 (zero_division = 0;
  classes = union of true and predicted labels) from the confusion counts;
* ROC-AUC (tie-aware Mann-Whitney) and average precision (step sum,
  sum of dR * P over distinct scores) from one table of counts per score.  The
  running sums over scores are computed range by range, so a run with many
  distinct scores is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred", times: str | None = None) -> DataFrame:
    n = F.sum(times).cast("long") if times else F.count(F.lit(1))
    return df.groupBy(*keys, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(n.alias("n"))


def per_class_metrics(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Per (run, class): tp, support, predicted, precision, recall, f1."""
    return class_scores(confusion(df, keys, y, pred), keys)


def class_scores(conf: DataFrame, keys: list[str]) -> DataFrame:
    """``per_class_metrics`` from confusion counts (keys, y, pred, n)."""
    as_true = conf.select(*keys, F.col("y").cast("string").alias("class"), F.col("n").alias("support"),
                          F.lit(0).cast("long").alias("predicted"),
                          F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp"))
    as_pred = conf.select(*keys, F.col("pred").cast("string").alias("class"), F.lit(0).cast("long").alias("support"),
                          F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"))
    cls = as_true.unionByName(as_pred).groupBy(*keys, "class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    cls = cls.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return cls.withColumn("f1", f1)


def classification_metrics(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred", digits: int = 9,
                           times: str | None = None) -> DataFrame:
    """accuracy, macro P/R/F1, weighted F1 per run (rounded to ``digits``)."""
    return confusion_metrics(confusion(df, keys, y, pred, times), keys, digits)


def confusion_metrics(conf: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """``classification_metrics`` from confusion counts (keys, y, pred, n)."""
    cls = class_scores(conf, keys)
    agg = cls.groupBy(*keys).agg(
        F.sum("tp").alias("_tp"), F.sum("support").alias("n"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), F.sum(F.col("f1") * F.col("support")).alias("_wf1"))
    return agg.select(
        *keys, "n",
        F.round(F.col("_tp") / F.col("n"), digits).alias("accuracy"),
        F.round("macro_precision", digits).alias("macro_precision"),
        F.round("macro_recall", digits).alias("macro_recall"),
        F.round("macro_f1", digits).alias("macro_f1"),
        F.round(F.col("_wf1") / F.col("n"), digits).alias("weighted_f1"))


def score_counts(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", positive=1, times: str | None = None) -> DataFrame:
    """Per (run, distinct score): positives and negatives."""
    is_pos = (F.col(y) == F.lit(positive))

    def number(which):
        return F.coalesce(F.sum(F.when(which, F.col(times))), F.lit(0)).cast("long") if times else F.count_if(which)

    return df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
        number(is_pos).alias("pos"), number(~is_pos).alias("neg"))


def running_totals(counts: DataFrame, keys: list[str], order: str, cols: list[str], descending: bool = False) -> DataFrame:
    """Add ``<c>_before`` = sum of ``c`` over rows strictly earlier in ``order`` within ``keys``.

    Rows are dealt to ranges of (keys, order) of about equal size, whatever the values' scale, and stored with the
    number of their range.  The totals of earlier ranges (a table of ranges x keys) are the offsets of a
    running sum inside each range.
    """
    sign = F.lit(-1.0) if descending else F.lit(1.0)
    ranges = max(8, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = counts.withColumn("_o", F.col(order).cast("double") * sign).repartitionByRange(ranges, *keys, "_o")
    dealt = dealt.withColumn("_b", F.spark_partition_id()).checkpoint(eager=True)
    tot = dealt.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    kw = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    prev = kw.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(prev), F.lit(0)).cast("long").alias(f"_off_{c}") for c in cols])
    inner = Window.partitionBy(*keys, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    same = [dealt[k].eqNullSafe(tot[k]) for k in keys]
    out = dealt.join(tot, [*same, dealt["_b"] == tot["_b"]]).select(dealt["*"], *[f"_off_{c}" for c in cols])
    out = out.withColumns({f"{c}_before": F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in cols})
    return out.drop("_b", "_o", *[f"_off_{c}" for c in cols])


def ranking_metrics(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", positive=1, digits: int = 9,
                    times: str | None = None) -> DataFrame:
    """E2 and E3 of each run from one pass over its distinct scores, high to low: roc_auc and pr_auc, null with one class.

    AUC = sum_s pos_s (neg_below_s + neg_s / 2) / (P N), tie-aware, with exact integer sums;
    AP = sum_s (pos_s / P) * tp_s / (tp_s + fp_s).
    """
    counts = running_totals(score_counts(df, keys, y, score, positive, times), keys, "score", ["pos", "neg"], descending=True)
    above = F.col("pos").cast("decimal(20,0)") * (2 * F.col("neg_before") + F.col("neg")).cast("decimal(20,0)")
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    term = F.when(tp + fp > 0, F.col("pos") * (tp / (tp + fp))).otherwise(F.lit(0.0))
    agg = counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(above).alias("_above"), F.sum(term).alias("_s"))
    pairs = F.lit(2).cast("decimal(20,0)") * F.col("P").cast("decimal(20,0)") * F.col("N").cast("decimal(18,0)")
    both = (F.col("P") > 0) & (F.col("N") > 0)
    auc = (pairs - F.col("_above")).cast("double") / (F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double"))
    return agg.select(*keys, F.when(both, auc).alias("roc_auc"), F.when(both, F.round(F.col("_s") / F.col("P"), digits)).alias("pr_auc"))


def roc_auc(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", positive=1) -> DataFrame:
    """E2 alone."""
    return ranking_metrics(df, keys, y, score, positive).select(*keys, "roc_auc")


def average_precision(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", positive=1, digits: int = 9,
                      times: str | None = None) -> DataFrame:
    """E3 alone."""
    return ranking_metrics(df, keys, y, score, positive, digits, times).select(*keys, "pr_auc")


def binary_metrics(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred", score: str = "score") -> DataFrame:
    """E1-E3 in one table: accuracy, macro/weighted scores, ROC-AUC, PR-AUC (one row per run key)."""
    if not keys:
        df, keys = df.withColumn("run", F.lit("all")), ["run"]
    base = classification_metrics(df, keys, y, pred)
    return base.join(ranking_metrics(df, keys, y, score), keys, "left")
