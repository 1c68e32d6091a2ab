"""What goes into the fits, row for row: imputed and encoded frames, weights, transfer splits, the splits a table allows (M1, M7,
X5, X7); and tables through the sinks and readers (K1, K2, S5, S8)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.experiments import task_frame, transfer_split
from flowlens.operators.models import prepared
from flowlens.operators.profile import file_profiles
from flowlens.operators.splits import available_splits, random_stratified_split
from flowlens.plans.q_audit import SHIPMENT_COLUMNS, SHIPMENT_IDS, SHIPMENT_SQL, shipment_table
from flowlens.plans.q_profile import raw_packets
from flowlens.plans.q_views import BIFLOW_SOURCE_SQL, biflow_source
from flowlens.plans.q_windows import flow_window_1h, flow_window_sql
from flowlens.plans.registry import query, table
from flowlens.session import scratch_path
from flowlens.sources.files import discover_files, read_any, read_delimited, select_variant
from flowlens.sources.sinks import write_report, write_table


def stratified_sql(src: str, label: str, ids: tuple[str, ...]) -> str:
    """DuckDB SQL: ``src`` with split (70/15/15 by class, rows of a class in md5 order)."""
    key = ", ".join(ids)
    return f"""SELECT * EXCLUDE (n_c, cut_train, cut_val, r_, key_), CASE WHEN r_ < cut_train THEN 'train' WHEN r_ < cut_val THEN 'val' ELSE 'test' END AS split FROM (
SELECT k.*, c.n_c, c.cut_train, c.cut_val, row_number() OVER (PARTITION BY k.{label} ORDER BY key_, {", ".join("k." + i for i in ids)}) - 1 AS r_
FROM (SELECT *, md5(concat_ws(':', '42', {key})) AS key_ FROM ({src})) k JOIN (
  SELECT *, train_c AS cut_train, train_c + b2 + CASE WHEN row_number() OVER (ORDER BY f2 DESC, {label}) <= t2 - sum(b2) OVER () THEN 1 ELSE 0 END AS cut_val FROM (
    SELECT *, (t2 * held_c) // nh AS b2, (t2 * held_c) % nh AS f2 FROM (
      SELECT *, CAST(sum(held_c) OVER () AS BIGINT) AS nh, CAST(sum(held_c) OVER () - ceil(CAST(0.5 AS DOUBLE) * sum(held_c) OVER ()) AS BIGINT) AS t2 FROM (
        SELECT *, n_c - train_c AS held_c FROM (
          SELECT *, b1 + CASE WHEN row_number() OVER (ORDER BY f1 DESC, {label}) <= t1 - sum(b1) OVER () THEN 1 ELSE 0 END AS train_c FROM (
            SELECT *, (t1 * n_c) // n AS b1, (t1 * n_c) % n AS f1 FROM (
              SELECT *, CAST(n - ceil(CAST(0.3 AS DOUBLE) * n) AS BIGINT) AS t1 FROM (
                SELECT {label}, count(*) AS n_c, CAST(sum(count(*)) OVER () AS BIGINT) AS n FROM ({src}) GROUP BY {label})))))))) c ON k.{label} = c.{label})"""


# --- M1, M7: a frame with gaps ---------------------------------------------------------
GAPS_SQL = f"""SELECT record_index, row_index, record_order, client_id, binary_label AS label,
  CASE WHEN row_index = 1 THEN NULL WHEN row_index = 2 THEN 'nan'::DOUBLE ELSE byte_quantity END AS byte_quantity,
  CASE WHEN row_index = 3 THEN NULL ELSE left(mode_signal, 1) END AS flag FROM ({SHIPMENT_SQL})"""

PREPARED_SQL = f"""WITH s AS ({stratified_sql(GAPS_SQL, "label", SHIPMENT_IDS)}),
t AS (SELECT * FROM s WHERE split = 'train'),
med AS (SELECT quantile_disc(byte_quantity, 0.5) AS m FROM t WHERE byte_quantity IS NOT NULL AND NOT isnan(byte_quantity)),
mo AS (SELECT flag AS f FROM t WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1),
c AS (SELECT label, (SELECT count(*) FROM t) / (CAST(2.0 AS DOUBLE) * count(*)) AS w FROM t GROUP BY label),
e AS (SELECT split, s.label, round(w, 9) AS weight, CASE WHEN byte_quantity IS NULL OR isnan(byte_quantity) THEN m ELSE byte_quantity END AS q, coalesce(flag, f) AS g
      FROM s JOIN c ON s.label = c.label, med, mo),
st AS (SELECT avg(q) AS mu, stddev_samp(q) AS sd FROM e WHERE split = 'train')
SELECT split, label AS y, weight, q AS byte_quantity, CAST(g = 'A' AS INTEGER) AS flag_A, CAST(g = 'N' AS INTEGER) AS flag_N, CAST(g = 'R' AS INTEGER) AS flag_R,
  round((q - mu) / sd, 6) AS z, count(*) AS n FROM e, st GROUP BY ALL"""


@query("prepared_frame", PREPARED_SQL)
def prepared_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1/M7: rows after imputation, encoding, scaling and weighting, counted by value."""
    rows = shipment_table(spark, sf_dir)
    line = F.col("row_index")
    rows = rows.select(*SHIPMENT_IDS, F.col("binary_label").alias("label"), F.when(line == 2, F.lit(float("nan"))).when(line != 1, F.col("byte_quantity")).alias("byte_quantity"),
                       F.when(line != 3, F.substring("mode_signal", 1, 1)).alias("flag"))
    split = random_stratified_split(rows, "label", list(SHIPMENT_IDS)).checkpoint(eager=True)
    counts = {r["label"]: r["count"] for r in split.where("split = 'train'").groupBy("label").count().collect()}
    prep = prepared(split, ["byte_quantity", "flag"], counts, list(SHIPMENT_IDS))
    x, at = vector_to_array("x"), {c: k for k, c in enumerate(prep.columns)}
    columns = [F.round("weight", 9).alias("weight"), x[at["byte_quantity"]].alias("byte_quantity"), *[x[at[f"flag_{v}"]].cast("int").alias(f"flag_{v}") for v in "ANR"],
               F.round(vector_to_array("z")[at["byte_quantity"]], 6).alias("z")]
    return prep.frame.select("split", "y", *columns).groupBy("split", "y", "weight", "byte_quantity", "flag_A", "flag_N", "flag_R", "z").agg(F.count(F.lit(1)).alias("n"))


# --- X7, X5 ------------------------------------------------------------------------------
_WINDOW = f"SELECT window_id, binary_label AS label FROM ({flow_window_sql([3600])}) WHERE binary_label IS NOT NULL"


@query("transfer_split", f"""SELECT 'windows_1h' AS origin, split, label, count(*) AS n FROM ({stratified_sql(_WINDOW, "label", ("window_id",))}) WHERE split <> 'test' GROUP BY ALL
UNION ALL SELECT 'biflow', 'test', binary_label, count(*) FROM ({BIFLOW_SOURCE_SQL}) WHERE binary_label IS NOT NULL GROUP BY ALL""")
def transfer_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and val rows of the windows, every biflow row as test, by label."""
    src, _ = task_frame(flow_window_1h(spark, sf_dir).select("window_id", "binary_label", "duration"), ["duration"], "binary", keep=["window_id"])
    tgt, _ = task_frame(biflow_source(spark, sf_dir).select("binary_label", "duration"), ["duration"], "binary")
    both = transfer_split(src, tgt, ["window_id"])
    origin = F.when(F.col("split") == "test", "biflow").otherwise("windows_1h")
    return both.groupBy(origin.alias("origin"), "split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("available_splits", """SELECT 'packets' AS dataset, 'random_stratified' AS split_type, NULL AS field
UNION ALL SELECT 'packets', 'group_split', 'source_file' FROM events HAVING count(DISTINCT event_type) > 1
UNION ALL SELECT 'packets', 'time_block_split', 'Timestamp' FROM events HAVING count(*) > 0
UNION ALL SELECT 'shipments', 'random_stratified', NULL
UNION ALL SELECT 'shipments', 'time_block_split', 'record_order' FROM lineitem HAVING count(*) > 0""")
def available_splits_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits that the raw packets and the shipments allow, with the field of each."""
    tables = {"packets": raw_packets(spark, sf_dir), "shipments": shipment_table(spark, sf_dir)}
    rows = [(name, kind, field) for name, df in tables.items() for kind, field in available_splits(df)]
    return spark.createDataFrame(rows, "dataset string, split_type string, field string")


# --- K1, K2, S5, S8: out and in again -----------------------------------------------------
@query("partitioned_roundtrip", SHIPMENT_SQL)
def partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments written as Parquet by class and read by suffix."""
    path = scratch_path(spark, f"views/{uuid.uuid4().hex}.parquet")
    write_table(shipment_table(spark, sf_dir), path, partition_by=["multiclass_label"])
    return read_any(spark, path).select(*SHIPMENT_COLUMNS)


@query("variant_files", """SELECT o_orderkey AS order_key, o_orderstatus AS status, o_totalprice AS price, 'selected_biflow_features' AS note
FROM orders WHERE o_orderkey % 2 = 0""")
def variant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of a table written as CSV; the files of the preferred one are read."""
    root = scratch_path(spark, f"variants/{uuid.uuid4().hex}")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    for name, part in (("biflow", 0), ("uniflow", 1)):
        write_report(orders.where(F.col("order key") % 2 == part), f"{root}/{name}")
    paths, note = select_variant([r["path"] for r in discover_files(spark, root).collect()])
    read = reduce(DataFrame.unionByName, [read_any(spark, p) for p in paths])
    return read.select(F.col("order_key").cast("long").alias("order_key"), "status", "price", F.lit(note).alias("note"))


# --- P1, P3: one row a file, unreadable ones too -------------------------------------------
def _profile_sql(name: str, src: str, fields: list[str], label: str, leakage: list[str], sensitive: list[str]) -> str:
    def listed(names: list[str]) -> str:
        return "[" + ", ".join(f'"{c}"' for c in names) + "]"

    missing = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in fields)
    return f"""SELECT 'files' AS dataset, '{name}' AS file_path, TRUE AS has_size, count(*) AS rows, {len(fields)} AS columns, '{listed(fields)}' AS fields, '{label}' AS label_column,
  (SELECT '{{' || string_agg('"' || v || '": ' || n, ', ' ORDER BY n DESC, v) || '}}' FROM (SELECT {label} AS v, count(*) AS n FROM ({src}) GROUP BY 1)) AS label_distribution,
  ({missing}) / (count(*) * CAST({len(fields)} AS DOUBLE)) AS missing_value_ratio, '{listed(leakage)}' AS suspicious_leakage_fields, '{listed(sensitive)}' AS suspicious_sensitive_fields, 'ok' AS read_status FROM ({src})"""


_ORDERS = "SELECT o_orderkey AS order_key, o_orderstatus AS attack_type, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price FROM orders"
_EVENTS = "SELECT event_id, event_type AS category, user_id AS client_id, props AS payload FROM events"
_BROKEN = """SELECT 'files', '{}', TRUE, NULL, NULL, '[]', NULL, '{{}}', NULL, '[]', '[]', 'failed'"""


@query("file_profile", " UNION ALL ".join([
    _profile_sql("orders.csv", _ORDERS, ["order_key", "attack_type", "price", "source_file"], "attack_type", ["attack_type"], []).replace("count(*) FILTER (WHERE source_file IS NULL)", "0"),
    _profile_sql("events.parquet", _EVENTS, ["event_id", "category", "client_id", "payload"], "category", ["category"], ["client_id", "payload"]),
    _BROKEN.format("broken.parquet"), _BROKEN.format("gone.parquet")]))
def file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV and a Parquet file, one whose content isn't what its name says, and one that isn't there."""
    root = scratch_path(spark, f"profiles/{uuid.uuid4().hex}")
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key.alias("order_key"), F.col("o_orderstatus").alias("attack_type"), F.when(key % 3 > 0, F.col("o_totalprice")).alias("price"))
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("category"), F.col("user_id").alias("client_id"), F.col("props").alias("payload"))
    write_report(orders, f"{root}/orders.csv")
    write_table(events, f"{root}/events.parquet")
    events.select("payload").write.text(f"{root}/broken.parquet")

    def read(spark: SparkSession, path: str) -> DataFrame:
        return read_any(spark, path) if path.endswith(".parquet") else read_delimited(spark, [r["path"] for r in discover_files(spark, path).collect()])

    found = file_profiles(spark, "files", [(f"{root}/{name}", 1) for name in ("orders.csv", "events.parquet", "broken.parquet", "gone.parquet")], read)
    return found.select("dataset", F.regexp_extract("file_path", "([^/]+)$", 1).alias("file_path"), (F.col("size_bytes") > 0).alias("has_size"), "rows", "columns", "fields", "label_column",
                        "label_distribution", "missing_value_ratio", "suspicious_leakage_fields", "suspicious_sensitive_fields",
                        F.when(F.col("read_status") == "ok", "ok").otherwise("failed").alias("read_status"))
