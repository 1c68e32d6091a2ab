"""Window-feature queries over the ``events`` stream table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.operators.windows import prepare_packets, window_features, window_profile
from flowlens.plans.registry import query, table

# events stand in for packets: ts -> timestamp, value -> length, event_type -> label
EVENT_LABEL_MAP = {"error": 1}


def event_packets(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return prepare_packets(events, ts="ts", length="value", label="event_type", keys=keys,
                           label_map=EVENT_LABEL_MAP, default_binary=0)


def flow_window_sql(widths, keys: tuple[str, ...] = (), anchor: str = "min") -> str:
    """DuckDB oracle: direct row-level lag per window, same exact arithmetic (anchor: first event or epoch)."""
    t0 = "(SELECT min(ts_us) FROM p)" if anchor == "min" else "0"
    k = "".join(f"{c}, " for c in keys)
    kp = ", ".join(keys)
    part = f"{kp}, window_seconds, window_id" if keys else "window_seconds, window_id"
    width_rows = " UNION ALL ".join(f"SELECT {int(w)} AS window_seconds, {int(w) * 1_000_000} AS w_us" for w in widths)
    return f"""
WITH p AS (
  SELECT {k}epoch_us(ts) AS ts_us,
         CAST(floor(value * 1000.0 + 0.5) AS BIGINT) AS len_u,
         CASE WHEN lower(trim(event_type)) = 'error' THEN 1 ELSE 0 END AS bl,
         trim(event_type) AS lbl
  FROM events
  WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND event_type IS NOT NULL
),
ws AS ({width_rows}),
w AS (
  SELECT p.*, ws.window_seconds, (p.ts_us - {t0}) // ws.w_us AS window_id
  FROM p CROSS JOIN ws
),
d AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {part} ORDER BY ts_us) AS d_us FROM w),
s AS (
  SELECT {part}, count(*) AS n,
    sum(CAST(len_u AS DECIMAL(20,0))) AS b_sum,
    sum(CAST(len_u AS DECIMAL(20,0)) * CAST(len_u AS DECIMAL(20,0))) AS b_sq,
    min(len_u) AS b_min, max(len_u) AS b_max, min(ts_us) AS first_us, max(ts_us) AS last_us,
    min(d_us) AS d_min, max(d_us) AS d_max,
    coalesce(sum(CAST(d_us AS DECIMAL(20,0)) * CAST(d_us AS DECIMAL(20,0))), 0) AS d_sq,
    max(bl) AS binary_label
  FROM d GROUP BY {part}
),
l AS (SELECT {part}, lbl, count(*) AS n_l, min(ts_us) AS first_l FROM w GROUP BY {part}, lbl),
m AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY n_l DESC, first_l, lbl) AS rk FROM l
  ) WHERE rk = 1
),
f AS (
  SELECT s.*, m.lbl, m.n_l,
    CAST(CAST(s.b_sum AS VARCHAR) AS DOUBLE) AS bs, CAST(CAST(s.b_sq AS VARCHAR) AS DOUBLE) AS bq,
    CAST(s.n AS DOUBLE) AS nd, CAST(s.last_us - s.first_us AS DOUBLE) AS span,
    CAST(s.n - 1 AS DOUBLE) AS md, CAST(CAST(s.d_sq AS VARCHAR) AS DOUBLE) AS dq
  FROM s JOIN m USING ({part})
),
g AS (
  SELECT *, bs / 1000.0 AS byte_sum, bs / 1000.0 / nd AS byte_mean,
    sqrt(greatest((bq - bs * bs / nd) / nd, 0.0)) / 1000.0 AS byte_std,
    span / 1000000.0 AS duration, span / md AS mu
  FROM f
)
SELECT {k}window_id, CAST(binary_label AS INTEGER) AS binary_label, lbl AS multiclass_label, window_seconds,
  n AS packet_count, byte_sum, byte_mean, byte_std,
  b_min / 1000.0 AS byte_min, b_max / 1000.0 AS byte_max, duration,
  CASE WHEN span > 0 THEN nd / duration ELSE nd / CAST(window_seconds AS DOUBLE) END AS packets_per_second,
  CASE WHEN span > 0 THEN byte_sum / duration ELSE byte_sum / CAST(window_seconds AS DOUBLE) END AS bytes_per_second,
  CASE WHEN n > 1 THEN mu / 1000000.0 ELSE 0.0 END AS iat_mean,
  CASE WHEN n > 1 THEN sqrt(greatest(dq / md - mu * mu, 0.0)) / 1000000.0 ELSE 0.0 END AS iat_std,
  CASE WHEN n > 1 THEN d_min / 1000000.0 ELSE 0.0 END AS iat_min,
  CASE WHEN n > 1 THEN d_max / 1000000.0 ELSE 0.0 END AS iat_max,
  CASE WHEN byte_mean > 0 THEN byte_std / byte_mean ELSE 0.0 END AS burstiness,
  1.0 - n_l / nd AS mixed_label_ratio
FROM g
"""


@query("flow_window_1h", flow_window_sql([3600]))
def flow_window_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hour tumbling windows anchored at the first event."""
    return window_features(event_packets(spark, sf_dir), widths=(3600,))


@query("flow_window_1d", flow_window_sql([86400]))
def flow_window_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-day tumbling windows."""
    return window_features(event_packets(spark, sf_dir), widths=(86400,))


SWEEP = (1, 5, 10, 3600)


@query("flow_window_sweep", flow_window_sql(SWEEP))
def flow_window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several widths computed from one slice table in one job."""
    return window_features(event_packets(spark, sf_dir), widths=SWEEP)


@query("per_user_window", flow_window_sql([86400], keys=("user_id",)))
def per_user_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed variant: windows per (user_id, day)."""
    return window_features(event_packets(spark, sf_dir, keys=("user_id",)), widths=(86400,), keys=("user_id",))


@query("window_profile", f"""
WITH wf AS ({flow_window_sql(SWEEP)})
SELECT window_seconds, count(*) AS rows, 18 AS columns,
  count(*) FILTER (WHERE mixed_label_ratio > 0) AS mixed_windows,
  round(avg(mixed_label_ratio), 9) AS mean_mixed_label_ratio
FROM wf GROUP BY window_seconds
""")
def window_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the window tables of the sweep."""
    return window_profile(flow_window_sweep(spark, sf_dir))
