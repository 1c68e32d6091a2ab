"""Leakage rules and observability-view queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.labels import label_to_binary
from flowlens.functions.names import norm
from flowlens.functions.rules import hard_reasons_expr
from flowlens.operators.flow import add_flow_metadata
from flowlens.operators.views import (
    Source, common_features, project_view, source_catalog, view_descriptors, view_features, view_membership,
)
from flowlens.operators.windows import WINDOW_COLUMNS
from flowlens.plans.q_flows import BIFLOW, SIDES, biflow_table, normalized_features_sql
from flowlens.plans.q_profile import TABLE_COLUMNS
from flowlens.plans.q_windows import flow_window_1h, flow_window_sql
from flowlens.plans.registry import TABLES, query, table
from flowlens.vocab import (
    ANALYSIS_PARAMETER_EXACT, COMMON_CROSS_FEATURES, HARD_LEAKAGE_EXACT, HARD_LEAKAGE_SUBSTRINGS, LABEL_COLUMNS,
    MQTT_METADATA_TOKENS, POLICY_MAIN, RAW_IDENTITY_SUBSTRINGS, REASON_ATTACK, REASON_CLIENT, REASON_IP, REASON_LABEL,
    REASON_SENSITIVE, REASON_TOPIC, STRICT_EXCLUDE_TOKENS, STRICT_TOKENS,
)

# --- source stand-ins ------------------------------------------------------------
PACKET_COLUMNS = ["binary_label", "multiclass_label", "record_index", "timestamp", "client_id", "label", "tcp_len",
                  "tcp_flags", "mqtt_kalive", "mqtt_msg"]
PACKET_SQL = """SELECT CASE WHEN lower(trim(event_type)) = 'error' THEN 1 ELSE 0 END AS binary_label,
  trim(event_type) AS multiclass_label, event_id AS record_index, ts AS timestamp, user_id AS client_id,
  event_type AS label, value AS tcp_len, lower(hex(user_id)) AS tcp_flags,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS mqtt_kalive, props AS mqtt_msg FROM events"""


def packet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in the packet schema (event_type is the label, error = attack)."""
    ev = table(spark, sf_dir, "events")
    out = ev.select(
        label_to_binary(F.col("event_type"), label_map={"error": 1}, default=0).alias("binary_label"),
        F.trim("event_type").alias("multiclass_label"), F.col("event_id").alias("record_index"),
        F.col("ts").alias("timestamp"), F.col("user_id").alias("client_id"), F.col("event_type").alias("label"),
        F.col("value").alias("tcp_len"), F.lower(F.hex("user_id")).alias("tcp_flags"),
        F.get_json_object("props", "$.k").cast("double").alias("mqtt_kalive"), F.col("props").alias("mqtt_msg"))
    assert out.columns == PACKET_COLUMNS
    return out


BIFLOW_RAW_COLUMNS = ["l_orderkey", "prt_src", "prt_dst"] + [
    f"{s}_{c}" for s in SIDES for c in ("num_pkts", "num_bytes", "min_pkt_len", "max_pkt_len", "min_iat", "max_iat",
                                        "num_psh_flags", "num_rst_flags")] + [
    f"{s}_{m}_{st}" for s in SIDES for st in ("pkt_len", "iat") for m in ("mean", "std")] + ["ip_src", "is_attack", "proto"]
BIFLOW_COLUMNS = ["record_index"] + BIFLOW_RAW_COLUMNS[1:] + list(COMMON_CROSS_FEATURES) + ["binary_label", "multiclass_label"]


def biflow_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biflow stand-in with the 14 common features and binary/multiclass labels."""
    raw = biflow_table(spark, sf_dir)
    assert raw.columns == BIFLOW_RAW_COLUMNS, raw.columns
    flows = add_flow_metadata(raw, mode="normalized").withColumnRenamed("l_orderkey", "record_index")
    flows = flows.withColumn("binary_label", F.col("is_attack").cast("int")).withColumn(
        "multiclass_label", F.when(F.col("is_attack") == 1, F.lit("attack")).otherwise(F.lit("benign")))
    return flows.select(*BIFLOW_COLUMNS)


BIFLOW_SOURCE_SQL = f"""SELECT l_orderkey AS record_index, * EXCLUDE (l_orderkey),
  is_attack AS binary_label, CASE WHEN is_attack = 1 THEN 'attack' ELSE 'benign' END AS multiclass_label
FROM ({normalized_features_sql(BIFLOW).replace('SELECT l_orderkey, is_attack, ', 'SELECT r.*, ', 1).replace(f'FROM ({BIFLOW})', f'FROM ({BIFLOW}) r', 1)})"""

WINDOW_SOURCE_COLUMNS = ["window_id", *WINDOW_COLUMNS]


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = flow_window_1h(spark, sf_dir)
    assert windows.columns == WINDOW_SOURCE_COLUMNS, windows.columns
    return windows


SOURCES = {"packets": ("packet", True, packet_table), "biflow": ("flow", True, biflow_source), "windows_1h": ("flow_window", True, _windows)}


def sources(spark: SparkSession, sf_dir: str, *names: str) -> list[Source]:
    """The named sources (all without a name); only these are built."""
    return [Source(n, SOURCES[n][0], SOURCES[n][1], SOURCES[n][2](spark, sf_dir)) for n in names or SOURCES]


SOURCE_COLUMNS = {"packets": ("packet", True, PACKET_COLUMNS), "biflow": ("flow", True, BIFLOW_COLUMNS),
                  "windows_1h": ("flow_window", True, WINDOW_SOURCE_COLUMNS)}


# --- the same rules in DuckDB SQL (oracle) -------------------------------------------
def _lst(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _any_contains(col: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({col}, '{norm(t)}')" for t in tokens) + ")"


def rules_sql(cols_sql: str) -> str:
    """CTE chain over (dataset, ordinal, col, kind, is_mqtt) ending in ``c`` with all flags."""
    reasons = f"""list_sort(list_distinct(list_filter([
    CASE WHEN low IN ({_lst(sorted({norm(x) for x in LABEL_COLUMNS}))}) OR low IN ({_lst(HARD_LEAKAGE_EXACT)}) THEN '{REASON_LABEL}' END,
    CASE WHEN {_any_contains('low', HARD_LEAKAGE_SUBSTRINGS)} THEN '{REASON_SENSITIVE}' END,
    CASE WHEN list_contains(ps, 'attack') OR list_contains(ps, 'scenario') OR list_contains(ps, 'category')
              OR list_contains(ps, 'class') THEN '{REASON_ATTACK}' END,
    CASE WHEN list_contains(ps, 'topic') THEN '{REASON_TOPIC}' END,
    CASE WHEN (list_contains(ps, 'ip') AND NOT (low IN ('orig_ip_bytes', 'resp_ip_bytes') OR suffix(low, '_ip_bytes')))
              OR {_any_contains('low', RAW_IDENTITY_SUBSTRINGS)} THEN '{REASON_IP}' END,
    CASE WHEN (list_contains(ps, 'client') AND list_contains(ps, 'id')) OR (list_contains(ps, 'device') AND list_contains(ps, 'id'))
         THEN '{REASON_CLIENT}' END], lambda x: x IS NOT NULL)))"""
    return f"""cols AS ({cols_sql}),
nrm AS (SELECT *, replace(replace(replace(lower(col), '.', '_'), '-', '_'), ' ', '_') AS low FROM cols),
prt AS (SELECT *, list_filter(string_split_regex(low, '[^0-9a-zA-Z]+'), lambda x: x <> '') AS ps FROM nrm),
rsn AS (SELECT *, {reasons} AS reasons FROM prt),
c AS (SELECT *, len(reasons) > 0 AS is_hard, col IN ({_lst(LABEL_COLUMNS)}) AS is_label,
        low IN ({_lst(ANALYSIS_PARAMETER_EXACT)}) AS is_analysis,
        {_any_contains('low', MQTT_METADATA_TOKENS)} AS broker_token,
        ({_any_contains('low', STRICT_TOKENS)} AND NOT {_any_contains('low', STRICT_EXCLUDE_TOKENS)}) AS strict_token
      FROM rsn)"""


def _values_sql(entries) -> str:
    rows = ", ".join(f"('{d}', {i}, '{c}', '{k}', {str(m).upper()})" for d, i, c, k, m in entries)
    return f"SELECT * FROM (VALUES {rows}) v(dataset, ordinal, col, kind, is_mqtt)"


SOURCE_ENTRIES = [(d, i, c, k, m) for d, (k, m, cols) in SOURCE_COLUMNS.items() for i, c in enumerate(cols)]

FEATURE_VIEWS_SQL = f"""WITH {rules_sql(_values_sql(SOURCE_ENTRIES))},
f AS (SELECT * FROM c WHERE NOT is_hard AND NOT is_analysis AND NOT is_label),
m AS (SELECT dataset, 'full' AS view_role, ordinal, col FROM f
      UNION ALL SELECT dataset, 'broker', ordinal, col FROM f WHERE is_mqtt AND (kind = 'flow_window' OR broker_token)
      UNION ALL SELECT dataset, 'strict', ordinal, col FROM f WHERE strict_token),
pol AS (SELECT * FROM (VALUES ('audited_metadata_main'), ('conservative_anti_leakage')) p(policy)),
rl AS (SELECT * FROM (VALUES ('full'), ('broker'), ('strict')) r(view_role)),
grid AS (SELECT DISTINCT dataset, kind, is_mqtt FROM cols),
g AS (SELECT * FROM grid CROSS JOIN pol CROSS JOIN rl),
inc AS (SELECT dataset, view_role, count(*) AS n, string_agg(col, ';' ORDER BY ordinal) AS names FROM m GROUP BY ALL),
hard AS (SELECT dataset, array_to_string(list_sort(list(col)), ';') AS h FROM c WHERE is_hard GROUP BY dataset),
ana AS (SELECT dataset, array_to_string(list_sort(list(col)), ';') AS a FROM c WHERE is_analysis GROUP BY dataset)
SELECT g.dataset, g.policy, g.view_role, g.view_role || '_' || g.policy AS view,
  CASE WHEN g.view_role = 'broker' AND NOT g.is_mqtt THEN 'not_applicable'
       WHEN coalesce(inc.n, 0) < 5 THEN 'weak_view' ELSE 'ok' END AS status,
  CAST(coalesce(inc.n, 0) AS INTEGER) AS n_features, coalesce(inc.names, '') AS included_features,
  coalesce(hard.h, '') AS excluded_hard_leakage_features, coalesce(ana.a, '') AS excluded_analysis_parameter_features,
  '' AS excluded_conservative_only_features,
  CASE WHEN g.policy = 'audited_metadata_main'
       THEN 'Main policy: hard leakage and sensitive content removed; legitimate encrypted-flow metadata retained.'
       ELSE 'Sensitivity policy: hard leakage removed plus single-feature Macro F1 > 0.90 metadata removed.' END AS notes
FROM g LEFT JOIN inc USING (dataset, view_role) LEFT JOIN hard USING (dataset) LEFT JOIN ana USING (dataset)"""


@query("feature_views", FEATURE_VIEWS_SQL)
def feature_views_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View descriptors of every source (no audit exclusions: conservative = main)."""
    catalog = source_catalog(spark, sources(spark, sf_dir))
    return view_descriptors(catalog, view_membership(catalog))


def _view(spark: SparkSession, sf_dir: str, dataset: str, role: str) -> DataFrame:
    (source,) = sources(spark, sf_dir, dataset)
    feats = view_features(view_membership(source_catalog(spark, [source])), dataset, POLICY_MAIN, role)
    return project_view(source.df, feats)


@query("audited_view_full", f"SELECT binary_label, multiclass_label, tcp_len, tcp_flags, mqtt_kalive FROM ({PACKET_SQL})")
def audited_view_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full view of the packet table (identity, time, label and raw-message columns removed)."""
    return _view(spark, sf_dir, "packets", "full")


@query("audited_view_broker", f"SELECT binary_label, multiclass_label, tcp_len, tcp_flags, mqtt_kalive FROM ({PACKET_SQL})")
def audited_view_broker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker-side view of the packet table (MQTT/TCP metadata tokens)."""
    return _view(spark, sf_dir, "packets", "broker")


@query("audited_view_strict", f"SELECT binary_label, multiclass_label, tcp_len, tcp_flags FROM ({PACKET_SQL})")
def audited_view_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict view of the packet table (MQTT application fields excluded) - a weak view of 2 features."""
    return _view(spark, sf_dir, "packets", "strict")


_WINDOW_STRICT = [c for c in WINDOW_COLUMNS if c not in ("binary_label", "multiclass_label", "window_seconds",
                                                          "mixed_label_ratio")]


@query("window_view_strict", f"SELECT binary_label, multiclass_label, {', '.join(_WINDOW_STRICT)} FROM ({flow_window_sql([3600])})")
def window_view_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict view of the one-hour window table (14 features; window id and width excluded)."""
    return _view(spark, sf_dir, "windows_1h", "strict")


@query("common_view", f"SELECT binary_label, multiclass_label, {', '.join(COMMON_CROSS_FEATURES)} FROM ({BIFLOW_SOURCE_SQL})")
def common_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biflow rows projected on the common features shared with the window strict view."""
    srcs = {s.dataset: s for s in sources(spark, sf_dir, "biflow", "windows_1h")}
    membership = view_membership(source_catalog(spark, list(srcs.values())))
    common = common_features(view_features(membership, "biflow", POLICY_MAIN, "strict"),
                             view_features(membership, "windows_1h", POLICY_MAIN, "strict"))
    return project_view(srcs["biflow"].df, common)


# --- hard rules over every table --------------------------------------------------------
def _driver_entries():
    return [(t, i, c, "table", False) for t in TABLES if TABLE_COLUMNS.get(t) for i, (c, _) in enumerate(TABLE_COLUMNS[t])]


HARD_RULES_SQL = f"""WITH {rules_sql(_values_sql(SOURCE_ENTRIES) + ' UNION ALL ' + f'''SELECT table_name AS dataset,
  CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name AS col, 'table' AS kind, FALSE AS is_mqtt
  FROM information_schema.columns WHERE table_name IN ({_lst([t for t in TABLES if TABLE_COLUMNS.get(t)])})''')}
SELECT dataset, col AS feature, 'hard_leakage_removed' AS feature_class, array_to_string(reasons, '; ') AS exclusion_reason,
  'remove_from_all_model_views' AS action FROM c WHERE is_hard"""


@query("hard_rules", HARD_RULES_SQL)
def hard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every table and stand-in with its sorted hard-leakage reasons."""
    frames = {t: table(spark, sf_dir, t) for t in TABLES if TABLE_COLUMNS.get(t)}
    rows = [(s.dataset, i, c) for s in sources(spark, sf_dir) for i, c in enumerate(s.df.columns)]
    rows += [(t, i, c) for t, df in frames.items() for i, c in enumerate(df.columns)]
    cols = spark.createDataFrame(rows, "dataset string, ordinal int, column string")
    reasons = cols.withColumn("r", hard_reasons_expr(F.col("column"))).where(F.size("r") > 0)
    return reasons.select("dataset", F.col("column").alias("feature"), F.lit("hard_leakage_removed").alias("feature_class"),
                          F.array_join("r", "; ").alias("exclusion_reason"),
                          F.lit("remove_from_all_model_views").alias("action"))

