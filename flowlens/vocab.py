"""Column and label vocabularies.

FIXED VALUES: the token lists below must equal the ones the audited
pipeline uses, otherwise label mapping, leakage rules and view membership
give different results.  They are kept verbatim, in their natural order.
"""

from __future__ import annotations

# --- fixed values: label normalisation -------------------------------------
BENIGN_TOKENS = ("benign", "normal", "legitimate", "legit", "nonattack", "non_attack", "clean", "false", "no", "0")
NULL_LABEL_TOKENS = ("", "<na>", "nan", "none", "null", "unknown")
FILENAME_BENIGN_TOKENS = ("normal", "benign", "legitimate", "legit")

# --- fixed values: label column detection and profiling --------------------
LABEL_EXACT = (
    "label", "labels", "target", "class", "classification", "is_attack",
    "attack", "attack_label", "attack_type", "attack_cat", "category",
)
LABEL_TOKENS = ("label", "target", "class", "attack", "category", "malicious", "anomaly")
LEAKAGE_TOKENS = ("label", "target", "attack", "scenario", "category", "class", "malicious", "benign", "normal", "is_attack")
SENSITIVE_TOKENS = (
    "payload", "topic", "mqtt_msg", "username", "user_name", "password", "passwd",
    "clientid", "client_id", "client id", "secret", "token", "auth", "credential",
    "ip", "addr", "mac", "hostname",
)

# --- fixed values: cleaning -------------------------------------------------
FORBIDDEN_MAIN_FEATURE_TOKENS = (
    "payload", "topic", "username", "user_name", "password", "passwd", "clientid",
    "client_id", "client id", "secret", "token", "auth", "credential", "ip", "addr",
    "mac", "host", "source_file", "file_name", "filename",
)
RAW_CONTENT_EXACT = ("mqtt_msg", "mqtt_message", "msg", "message", "raw_message", "content")
TEMPORAL_LEAKAGE_EXACT = ("timestamp", "time_epoch", "frame_time", "datetime", "date_time")

# --- fixed values: leakage rules and views ---------------------------------
LABEL_COLUMNS = ("binary_label", "binary_label_name", "multiclass_label", "label", "labels", "target")
HARD_LEAKAGE_EXACT = (
    "label", "labels", "target", "attack", "attack_type", "attack_cat", "class", "category",
    "scenario", "scenario_name", "source_file", "file_name", "filename", "capture_name",
    "pcap_name", "client_id", "clientid", "device_id", "deviceid", "username", "user_name",
    "password", "passwd", "topic", "payload", "mqtt_msg", "mqtt_message", "raw_message",
    "message", "content", "timestamp", "time_epoch", "frame_time", "datetime", "date_time",
    "row_index", "record_index", "record_order", "index",
)
HARD_LEAKAGE_SUBSTRINGS = (
    "source_file", "file_name", "filename", "capture_name", "pcap_name", "scenario_name",
    "clientid", "client_id", "deviceid", "device_id", "username", "password", "passwd",
    "payload", "mqtt_msg", "timestamp", "time_epoch", "frame_time", "datetime", "date_time",
    "row_index", "record_index", "record_order", "window_id",
)
RAW_IDENTITY_SUBSTRINGS = (
    "src_ip", "dst_ip", "source_ip", "destination_ip", "ip_address", "attacker_ip",
    "victim_ip", "id_orig_h", "id_resp_h", "orig_h", "resp_h", "mac", "hostname", "uid",
)
ANALYSIS_PARAMETER_EXACT = ("window_seconds",)
MQTT_METADATA_TOKENS = (
    "mqtt", "tcp", "flag", "qos", "len", "length", "session", "connect", "conack", "kalive",
    "keep", "packet", "pkt", "byte", "duration", "iat", "rate", "burst", "flow", "proto",
    "prt", "port",
)
STRICT_TOKENS = (
    "duration", "packet", "pkt", "pkts", "byte", "bytes", "len", "length", "sum", "mean",
    "std", "min", "max", "iat", "rate", "burst", "flag", "count", "proto", "protocol",
    "service", "conn_state", "missed", "history", "ttl", "variance", "prt", "port",
)
STRICT_EXCLUDE_TOKENS = ("mqtt_", "topic", "payload", "user", "pass", "client", "timestamp", "source_file")
COMMON_CROSS_FEATURES = (
    "packet_count", "byte_sum", "byte_mean", "byte_std", "byte_min", "byte_max", "duration",
    "iat_mean", "iat_std", "iat_min", "iat_max", "bytes_per_second", "packets_per_second",
    "burstiness",
)
LEGITIMATE_METADATA_TOKENS = (
    "duration", "packet_count", "num_pkts", "pkt", "pkts", "byte", "bytes", "pkt_len",
    "packet_len", "iat", "bytes_per_second", "packets_per_second", "burstiness", "flow_rate",
    "flag", "tcp_flag", "psh_flags", "rst_flags", "urg_flags",
)
PROTOCOL_METADATA_TOKENS = ("prt_", "port", "proto", "protocol", "service", "conn_state", "history")

# --- fixed values: reason and class names ----------------------------------
REASON_LABEL = "hard_leakage:label_or_explicit_forbidden_field"
REASON_SENSITIVE = "hard_leakage:sensitive_content_identity_timestamp_or_order"
REASON_ATTACK = "hard_leakage:attack_scenario_or_class_semantics"
REASON_TOPIC = "hard_leakage:raw_topic_string"
REASON_IP = "hard_leakage:raw_ip_or_endpoint_identity"
REASON_CLIENT = "hard_leakage:client_or_device_identity"

# reason -> which column names have it: ``exact`` names, ``substrings``, or ``words`` (name parts of which all of one tuple
# occur, unless the name ends in one of ``unless_ending``)
HARD_LEAKAGE_RULES = {
    REASON_LABEL: {"exact": LABEL_COLUMNS + HARD_LEAKAGE_EXACT},
    REASON_SENSITIVE: {"substrings": HARD_LEAKAGE_SUBSTRINGS},
    REASON_ATTACK: {"words": (("attack",), ("scenario",), ("category",), ("class",))},
    REASON_TOPIC: {"words": (("topic",),)},
    REASON_IP: {"substrings": RAW_IDENTITY_SUBSTRINGS, "words": (("ip",),), "unless_ending": ("_ip_bytes",)},
    REASON_CLIENT: {"words": (("client", "id"), ("device", "id"))},
}
HIGH_SCORE, DISCRIMINATIVE_SCORE = 0.90, 0.80
# kind of feature, in order of precedence -> (feature class, action, action if the score is high)
AUDIT_CLASSES = {
    "hard": ("hard_leakage_removed", "remove_from_all_model_views", "remove_from_all_model_views"),
    "legitimate": ("legitimate_metadata_retained", "retain_in_audited_metadata_main",
                   "retain_in_audited_metadata_main; conservative_only_removed"),
    "protocol": ("suspicious_protocol_metadata_retained", "retain_with_protocol_metadata_note",
                 "retain_with_protocol_metadata_note"),
    "high": ("conservative_only_removed", "retain_in_main_remove_in_conservative", "retain_in_main_remove_in_conservative"),
    "other": ("retained_metadata", "retain", "retain"),
}
DISCRIMINATIVE_CLASSES = ("legitimate_metadata_retained", "suspicious_protocol_metadata_retained", "conservative_only_removed")
NOTE_LEGITIMATE = "single-feature Macro F1 > 0.90; legitimate encrypted-flow metadata, not leakage"
NOTE_DISCRIMINATIVE = "single-feature Macro F1 > 0.80; discriminative metadata"
NOTE_NONE = "no leakage indication under revised taxonomy"

# --- fixed values: splits ----------------------------------------------------
GROUP_CANDIDATES = (
    "source_file", "capture", "capture_name", "pcap", "pcap_name", "scenario",
    "scenario_name", "session", "session_id", "source_capture",
)
TIME_CANDIDATES = (
    "timestamp", "time_epoch", "frame_time", "datetime", "date_time", "record_order",
    "row_index", "index",
)

# --- fixed values: Zeek connection logs ------------------------------------
ZEEK_NUMERIC_COLUMNS = (
    "duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "orig_ip_bytes",
    "resp_pkts", "resp_ip_bytes",
)
ZEEK_HISTORY_CHARS = ("D", "d", "S", "h", "H", "A", "F", "R", "r", "^", "I", "Q")
ZEEK_NULL_TOKENS = ("-", "(empty)", "")

# --- fixed values: experiment grid -----------------------------------------
SEEDS = (42, 7, 13, 21, 100)
# family -> (tokens of which a name has one, tokens it must not have, whether the family is all other names)
FAMILY_RULES = {
    "packet_count_only": (("packet_count", "num_pkts"), (), False),
    "byte_statistics_only": (("byte", "pkt_len", "num_bytes"), ("per_second",), False),
    "iat_statistics_only": (("iat",), (), False),
    "rate_features_only": (("per_second", "rate", "burstiness"), (), False),
    "tcp_flags_only": (("flag",), (), False),
    "all_metadata": (("",), (), False),
    "all_without_byte_stats": (("byte", "pkt_len", "num_bytes"), ("per_second",), True),
    "all_without_iat": (("iat",), (), True),
    "all_without_rate": (("per_second", "rate", "burstiness"), (), True),
}
FEATURE_FAMILIES = tuple(FAMILY_RULES)

# --- fixed values: columns that flow metadata is made of -----------------------
# target -> (forward columns, backward columns, column of one-way tables); the first existing column of each list counts
FLOW_TOTALS = {
    "packet_count": (("fwd_num_pkts", "orig_pkts"), ("bwd_num_pkts", "resp_pkts"), "num_pkts"),
    "byte_sum": (("fwd_num_bytes", "orig_bytes", "orig_ip_bytes"), ("bwd_num_bytes", "resp_bytes", "resp_ip_bytes"), "num_bytes"),
}
# target statistic -> the suffix that forward, backward and one-way columns share
FLOW_STATISTICS = {
    "byte_mean": "mean_pkt_len", "byte_std": "std_pkt_len", "iat_mean": "mean_iat", "iat_std": "std_iat",
    "byte_min": "min_pkt_len", "iat_min": "min_iat", "byte_max": "max_pkt_len", "iat_max": "max_iat",
}
# ratio -> (numerator, denominator)
FLOW_RATIOS = {
    "packets_per_second": ("packet_count", "duration"), "bytes_per_second": ("byte_sum", "duration"),
    "burstiness": ("byte_std", "byte_mean"),
}
VIEW_ROLES = ("full", "broker", "strict")
POLICY_MAIN = "audited_metadata_main"
POLICY_CONSERVATIVE = "conservative_anti_leakage"
