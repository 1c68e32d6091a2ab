"""Plan shape guards (pruning, exchanges) and policy / cleaning edge cases."""

from pyspark.sql import functions as F

from flowlens.operators.clean import preprocess_table
from flowlens.operators.views import Source, conservative_exclusions, source_catalog, view_membership
from flowlens.plans import QUERIES

SF = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_plan_prunes_and_shuffles_rows_once(spark):
    plan = _plan(QUERIES["flow_window_sweep"](spark, SF))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 1 and "[ts#" in scans[0] and "user_id" not in scans[0] and "props" not in scans[0]
    assert plan.count("Exchange hashpartitioning(slice_id") == 1


def test_split_has_no_row_level_single_partition(spark):
    plan = _plan(QUERIES["stratified_split"](spark, SF))
    for line in plan.splitlines():
        if "SinglePartition" in line:
            # only the class-level allocation table may be gathered; it sits on top of an aggregate
            assert "Exchange SinglePartition" in line
    assert "FileScan parquet" in plan


def test_conservative_wildcard(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 0)], "packet_count double, byte_sum double, iat_mean double, binary_label int")
    cat = source_catalog(spark, [Source("a", "flow", True, df), Source("b", "flow", True, df)])
    report = spark.createDataFrame([("*", "byte_sum", 0.95), ("a", "iat_mean", 0.99), ("b", "packet_count", 0.5)],
                                   "dataset string, feature string, single_feature_macro_f1 double")
    m = view_membership(cat, conservative_exclusions(report)).where("policy = 'conservative_anti_leakage' AND view_role = 'full'")
    got = {(r["dataset"], r["feature"]) for r in m.collect()}
    assert got == {("a", "packet_count"), ("b", "packet_count"), ("b", "iat_mean")}


def test_preprocess_filename_labels_and_missing_rows(spark):
    rows = [("normal_traffic.csv", 1.0, 10.0), ("normal_traffic.csv", 2.0, 11.0),
            ("dos_flood.csv", 3.0, 12.0), ("dos_flood.csv", 4.0, 13.0)]
    df = spark.createDataFrame(rows, "source_file string, duration double, byte_count double")
    # original detection: a low-cardinality column becomes the label (tie -> smaller name)
    _, quirk = preprocess_table(df, "t")
    assert quirk.first()["detected_label_column"] == "byte_count"
    cleaned, meta = preprocess_table(df, "t", min_label_score=3)
    assert meta.first()["detected_label_column"] is None
    got = sorted((r["binary_label"], r["multiclass_label"]) for r in cleaned.collect())
    assert got == [(0, "benign"), (0, "benign"), (1, "dos_flood"), (1, "dos_flood")]
    labelled = spark.createDataFrame([("a.csv", "benign", 1.0), ("a.csv", "unknown", 2.0), ("a.csv", "ddos", 3.0)],
                                     "source_file string, label string, x double")
    cleaned2, meta2 = preprocess_table(labelled, "u")
    m = meta2.first()
    assert m["dropped_missing_label_rows"] == 1 and m["detected_label_column"] == "label"
    assert cleaned2.where(F.col("binary_label") == 1).count() == 1
