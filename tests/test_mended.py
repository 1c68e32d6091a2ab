"""Rules that earlier rounds got wrong: null metrics, unseen categories, non-finite metrics, row ids, plans without row shuffles."""

import math

import pytest
from pyspark.sql import functions as F

from flowlens.operators.clean import encode_labels, label_codes, rare_class_filter
from flowlens.operators.experiments import family_features, finite, with_row_id
from flowlens.operators.flow import add_flow_metadata
from flowlens.operators.models import prepared
from flowlens.operators.profile import detect_label_column, few_valued
from flowlens.operators.results import argmax_row


def test_a_null_metric_never_wins(spark):
    runs = spark.createDataFrame([("d", "A", None, "ok"), ("d", "B", 0.9, "ok"), ("d", "C", 0.9, "ok"), ("e", "A", None, "ok")],
                                 "dataset string, model string, macro_f1 double, status string")
    got = {r["dataset"]: (r["best_model"], r["best_macro_f1"]) for r in argmax_row(runs, ["dataset"]).collect()}
    assert got == {"d": ("B", 0.9), "e": (None, None)}


def test_an_unseen_category_is_the_zero_vector(spark):
    rows = [("train", k, c, k % 2) for k, c in enumerate(["a", "b", "a", None])] + [("test", 10 + k, c, 0) for k, c in enumerate(["a", "b", "new", None])]
    frame = spark.createDataFrame(rows, "split string, id long, c string, label int")
    prep = prepared(frame, ["c"], {0: 2, 1: 2}, ["id"])
    assert prep.columns == ["c_a", "c_b"] and prep.sources == ["c", "c"]
    got = sorted(r["x"].toArray().tolist() for r in prep.frame.where("split = 'test'").collect())
    assert got == [[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0]]


def test_a_column_without_train_values_is_zero(spark):
    rows = [("train", k, None, float(k), k % 2) for k in range(6)] + [("test", 9, 7.0, None, 1)]
    frame = spark.createDataFrame(rows, "split string, id long, gone double, n double, label int")
    prep = prepared(frame, ["gone", "n"], {0: 3, 1: 3}, ["id"])
    (x,) = [r["x"].toArray().tolist() for r in prep.frame.where("split = 'test'").collect()]
    assert x[0] == 0.0 and 2.0 <= x[1] <= 3.0 and prep.columns == ["gone", "n"]


@pytest.mark.parametrize("value,want", [(0.5, 0.5), (None, None), (math.nan, None), (math.inf, None), (-math.inf, None)])
def test_metrics_are_finite_or_null(value, want):
    assert finite(value) == want


def test_row_ids_do_not_depend_on_the_partitions(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("a"), F.col("id").cast("string").alias("b"))
    one, _ = with_row_id(df.repartition(1), None)
    many, ids = with_row_id(df.repartition(9), None)
    assert ids == ["__rid"] and sorted(one.collect()) == sorted(many.collect())


def test_families():
    names = ["fwd_num_bytes", "bytes_per_second", "iat_mean", "packet_count", "tcp_flag_syn", "burstiness"]
    assert family_features(names, "byte_statistics_only") == ["fwd_num_bytes"]
    assert family_features(names, "all_without_byte_stats") == names[1:]
    assert family_features(names, "rate_features_only") == ["bytes_per_second", "burstiness"]
    assert family_features(names, "all_metadata") == names


def test_flow_rules_build_on_one_another(spark):
    df = spark.createDataFrame([(2.0, 4.0, 10.0, None, 0.5, 1.5), (None, 0.0, 3.0, 3.0, 2.0, 1.0)],
                               "fwd_num_pkts double, bwd_num_pkts double, orig_bytes double, resp_bytes double, fwd_max_iat double, bwd_max_iat double")
    rows = add_flow_metadata(df).collect()
    assert [(r["packet_count"], r["byte_sum"], r["byte_mean"], r["duration"], r["packets_per_second"]) for r in rows] == [
        (6.0, 10.0, 10.0 / 6.0, 1.5, 4.0), (0.0, 6.0, None, 2.0, 0.0)]
    assert "byte_sum" not in add_flow_metadata(df, "common").columns


def test_class_tables_do_not_shuffle_rows_on_the_label(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("y"))
    codes = label_codes(df, "y")
    assert [(r["y"], r["code"]) for r in codes.orderBy("code").collect()] == [("0", 0), ("1", 1), ("2", 2)]
    for out in (rare_class_filter(df, "y", 3), encode_labels(df, "y", codes)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_label_column_uses_all_rows(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") < 10_000, 0).otherwise(F.col("id") % 40).alias("kind"), (F.col("id") % 60).alias("many"))
    assert few_valued(df, df.columns) == {"kind": 40}
    assert detect_label_column(df) == "kind"
    assert detect_label_column(df.withColumn("Target", F.lit(1))) == "Target"
