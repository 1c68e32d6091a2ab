"""Column drop rules and flow metadata on edge rows."""

import math

from pyspark.sql import functions as F

from flowlens.operators.clean import column_drop_plan, high_cardinality_strings, rare_class_filter
from flowlens.operators.flow import add_flow_metadata


def test_drop_plan(spark):
    rows = [(i, float(i), float(i), None, 5, 5 if i else None, f"s{i}", "k") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, a double, a_copy double, empty double, const int, const_null int, "
                                     "s string, binary_label string")
    plan = {r["column"]: (r["status"], r["duplicate_of"]) for r in column_drop_plan(df).collect()}
    assert plan["a_copy"] == ("dropped_duplicate", "a")
    assert plan["empty"][0] == "dropped_empty"
    assert plan["const"][0] == "dropped_constant"
    assert plan["const_null"][0] == "kept"      # null counts as a value
    assert plan["binary_label"][0] == "kept"    # labels are exempt
    assert plan["id"][0] == "kept" and plan["a"][0] == "kept"


def test_high_cardinality_and_rare(spark):
    df = spark.range(6000).select(F.col("id").cast("string").alias("uid"), (F.col("id") % 3).cast("string").alias("c"))
    status = {r["column"]: r["status"] for r in high_cardinality_strings(df).collect()}
    assert status == {"uid": "dropped_high_cardinality", "c": "kept"}
    small = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "y string")
    assert rare_class_filter(small, "y", 3).count() == 3


def test_flow_metadata_edge_rows(spark):
    rows = [(3.0, None, 300.0, None, 100.0, None, 2.0, None, 0.0, None),
            (2.0, 2.0, 100.0, 50.0, 50.0, 25.0, float("inf"), 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "fwd_num_pkts double, bwd_num_pkts double, fwd_num_bytes double, bwd_num_bytes double, "
                                     "fwd_mean_pkt_len double, bwd_mean_pkt_len double, fwd_max_iat double, "
                                     "bwd_max_iat double, fwd_std_pkt_len double, bwd_std_pkt_len double")
    out = add_flow_metadata(df).collect()
    a, b = out
    assert a["packet_count"] == 3.0 and a["byte_sum"] == 300.0 and a["byte_mean"] == 100.0
    assert a["duration"] == 2.0 and a["packets_per_second"] == 1.5 and a["burstiness"] == 0.0
    assert b["duration"] is None and b["iat_max"] is None   # +inf -> null
    assert b["byte_mean"] == 37.5 and b["burstiness"] == 0.0
    common = add_flow_metadata(df, mode="common").collect()
    assert common[1]["packets_per_second"] == 0.0 and not math.isnan(common[1]["bytes_per_second"])
