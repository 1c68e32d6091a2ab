"""Leakage rules and view membership against the audited pipeline's committed view sizes."""

from pyspark.sql import functions as F

from flowlens.functions.names import normalize_column_name, unique_columns
from flowlens.functions.rules import hard_reasons_expr
from flowlens.operators.views import Source, source_catalog, view_descriptors, view_membership
from flowlens.operators.flow import history_column
from flowlens.operators.windows import WINDOW_COLUMNS
from flowlens.vocab import ZEEK_HISTORY_CHARS

PACKET = ["binary_label", "multiclass_label", "tcp_flags", "tcp_len", "mqtt_conack_flags", "mqtt_conflag_cleansess",
          "mqtt_conflags", "mqtt_dupflag", "mqtt_hdrflags", "mqtt_kalive", "mqtt_qos"]
BIFLOW = ["binary_label", "multiclass_label", "prt_src", "prt_dst", "proto"] + [
    f"{s}_{c}" for c in ("num_pkts", "mean_iat", "std_iat", "min_iat", "max_iat", "mean_pkt_len", "std_pkt_len",
                         "min_pkt_len", "max_pkt_len", "num_bytes", "num_psh_flags", "num_rst_flags") for s in ("fwd", "bwd")
] + ["fwd_num_urg_flags", "packet_count", "byte_sum", "byte_mean", "byte_std", "iat_mean", "iat_std", "byte_min",
     "iat_min", "byte_max", "iat_max", "duration", "packets_per_second", "bytes_per_second", "burstiness"]
ZEEK = ["binary_label", "multiclass_label", "source_file", "duration", "orig_bytes", "resp_bytes", "orig_pkts",
        "resp_pkts", "orig_ip_bytes", "resp_ip_bytes", "missed_bytes", "proto", "service", "conn_state",
        "history_len"] + [history_column(c) for c in ZEEK_HISTORY_CHARS] + [
    "total_bytes", "total_pkts", "bytes_per_second", "packets_per_second", "packet_count", "byte_sum", "byte_mean"]


def _frame(spark, cols):
    return spark.createDataFrame([tuple([None] * len(cols))], ", ".join(f"`{c}` string" for c in cols))


def test_view_sizes_match_committed_results(spark):
    srcs = [Source("packets", "packet", True, _frame(spark, PACKET)),
            Source("biflow", "flow", True, _frame(spark, BIFLOW)),
            Source("zeek", "flow", False, _frame(spark, ZEEK)),
            Source("windows_5s", "flow_window", True, _frame(spark, ["window_id", *WINDOW_COLUMNS]))]
    cat = source_catalog(spark, srcs)
    desc = {(r["dataset"], r["view_role"]): (r["n_features"], r["status"])
            for r in view_descriptors(cat, view_membership(cat)).where("policy = 'audited_metadata_main'").collect()}
    assert desc[("packets", "full")] == (9, "ok")
    assert desc[("packets", "broker")] == (9, "ok")
    assert desc[("packets", "strict")] == (2, "weak_view")
    assert [desc[("biflow", r)][0] for r in ("full", "broker", "strict")] == [42, 42, 42]
    assert desc[("zeek", "full")][0] == 31 and desc[("zeek", "strict")][0] == 31
    assert desc[("zeek", "broker")][1] == "not_applicable"
    assert [desc[("windows_5s", r)][0] for r in ("full", "broker", "strict")] == [15, 15, 14]


def test_hard_reasons(spark):
    names = ["source_file", "orig_ip_bytes", "src_ip", "client_id", "attack_cat", "mqtt_topic", "tcp_len", "Label"]
    df = spark.createDataFrame([(n,) for n in names], "c string").select("c", hard_reasons_expr(F.col("c")).alias("r"))
    got = {r["c"]: r["r"] for r in df.collect()}
    assert got["source_file"] == ["hard_leakage:label_or_explicit_forbidden_field",
                                  "hard_leakage:sensitive_content_identity_timestamp_or_order"]
    assert got["orig_ip_bytes"] == []
    assert got["src_ip"] == ["hard_leakage:raw_ip_or_endpoint_identity"]
    assert "hard_leakage:client_or_device_identity" in got["client_id"]
    assert got["attack_cat"][0] == "hard_leakage:attack_scenario_or_class_semantics" or \
        "hard_leakage:attack_scenario_or_class_semantics" in got["attack_cat"]
    assert got["mqtt_topic"] == ["hard_leakage:raw_topic_string"]
    assert got["tcp_len"] == []
    assert got["Label"] == ["hard_leakage:label_or_explicit_forbidden_field"]


def test_column_names():
    assert normalize_column_name("  Fwd Pkt.Len-Max ") == "Fwd_Pkt_Len_Max"
    assert normalize_column_name("%%") == "unnamed"
    assert unique_columns(["a.b", "a-b", "x"]) == ["a_b", "a_b_2", "x"]
    out = unique_columns(["history_count_D", "history_count_d"])
    assert len({c.lower() for c in out}) == 2
