"""Metrics against their textbook definitions (O(n^2) AUC, step-sum AP, per-class F1)."""

import random

from pyspark.sql import functions as F

from flowlens.operators.metrics import average_precision, classification_metrics, roc_auc


def auc_pairs(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def ap_steps(y, s):
    P = sum(y)
    pairs = sorted(zip(s, y), key=lambda t: -t[0])
    ap, tp, fp, prev_r, i = 0.0, 0, 0, 0.0, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            tp += pairs[j][1]
            fp += 1 - pairs[j][1]
            j += 1
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r, i = r, j
    return ap


def test_auc_ap_with_ties(spark):
    rnd = random.Random(3)
    rows = [(int(rnd.random() < 0.3), float(rnd.randint(0, 20))) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, score double").withColumn("run", F.lit("r"))
    y, s = [r[0] for r in rows], [r[1] for r in rows]
    assert abs(roc_auc(df, ["run"]).first()["roc_auc"] - auc_pairs(y, s)) < 1e-12
    assert abs(average_precision(df, ["run"]).first()["pr_auc"] - ap_steps(y, s)) < 1e-8


def test_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, score double").withColumn("run", F.lit("r"))
    assert roc_auc(df, ["run"]).first()["roc_auc"] is None


def test_macro_weighted_union_of_classes(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "c"), ("a", "a")]
    df = spark.createDataFrame(rows, "y string, pred string").withColumn("run", F.lit("r"))
    m = classification_metrics(df, ["run"]).first()
    # classes a, b, c (c only predicted): P = (1, .5, 0), R = (2/3, .5, 0), F1 = (.8, .5, 0)
    assert abs(m["macro_precision"] - 0.5) < 1e-9
    assert abs(m["macro_recall"] - (2 / 3 + 0.5) / 3) < 1e-9
    assert abs(m["macro_f1"] - 1.3 / 3) < 1e-9
    assert abs(m["weighted_f1"] - (0.8 * 3 + 0.5 * 2) / 5) < 1e-9
    assert abs(m["accuracy"] - 0.6) < 1e-9
