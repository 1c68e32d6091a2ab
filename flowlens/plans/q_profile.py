"""Profiling, label and cleaning queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.labels import label_to_binary
from flowlens.functions.numeric import NUMBER_PATTERN
from flowlens.operators.clean import column_drop_plan, high_cardinality_strings, label_codes, rare_class_filter
from flowlens.operators.profile import column_missing, label_distribution, table_profile
from flowlens.plans.registry import query, table
from flowlens.vocab import BENIGN_TOKENS, NULL_LABEL_TOKENS

# schema-level column lists of the driver tables (for generating oracle SQL)
TABLE_COLUMNS = {
    "region": [("r_regionkey", "n"), ("r_name", "s")],
    "nation": [("n_nationkey", "n"), ("n_name", "s"), ("n_regionkey", "n")],
    "customer": [("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "d"), ("c_mktsegment", "s")],
    "supplier": [("s_suppkey", "n"), ("s_name", "s"), ("s_nationkey", "n"), ("s_acctbal", "d")],
    "part": [("p_partkey", "n"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "n"),
             ("p_retailprice", "d")],
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "d"),
               ("o_orderdate", "t"), ("o_orderpriority", "s")],
    "lineitem": [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"),
                 ("l_quantity", "d"), ("l_extendedprice", "d"), ("l_discount", "d"), ("l_tax", "d"),
                 ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t")],
    "events": [("event_id", "n"), ("ts", "t"), ("user_id", "n"), ("event_type", "s"), ("value", "d"), ("props", "s")],
    "documents": [("doc_id", "n"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "n")],
    "labels": [("doc_id", "n"), ("quality", "n"), ("toxic", "n")],
    "embeddings": [("vec_id", "n"), ("embedding", "a"), ("label", "n")],
    "pages": [("page_id", "n"), ("url", "s"), ("html", "s")],
    "benchmark": [("item_id", "n"), ("text", "s")],
    "conversations": [("conv_id", "n"), ("turn", "n"), ("role", "s"), ("text", "s")],
}
PROFILED = tuple(t for t, cols in TABLE_COLUMNS.items() if cols)


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_label_to_binary(expr: str) -> str:
    """DuckDB form of the label rule (substring mode)."""
    t = f"lower(trim(CAST({expr} AS VARCHAR)))"
    contains = " OR ".join(f"contains({t}, '{tok}')" for tok in BENIGN_TOKENS)
    return f"""CASE
  WHEN {expr} IS NULL OR {t} IN ({_sql_list(NULL_LABEL_TOKENS)}) THEN NULL
  WHEN {t} IN ({_sql_list(BENIGN_TOKENS)}) THEN 0
  WHEN {t} IN ('false', 'f') THEN 0
  WHEN {t} IN ('true', 't') THEN 1
  WHEN regexp_matches({t}, '{NUMBER_PATTERN}') THEN
    CASE WHEN TRY_CAST(replace({t}, '_', '') AS DOUBLE) = 0 THEN 0 ELSE 1 END
  WHEN {contains} THEN 0
  ELSE 1 END"""


LABEL_SOURCES = (("orders", "o_orderpriority"), ("part", "p_type"), ("events", "event_type"),
                 ("conversations", "role"), ("documents", "source"), ("documents", "lang"))


@query("label_to_binary", " UNION ALL ".join(
    f"SELECT '{t}.{c}' AS source, CAST({c} AS VARCHAR) AS label_value, CAST({sql_label_to_binary(c)} AS INTEGER) AS binary_label, "
    f"count(*) AS count FROM {t} GROUP BY ALL" for t, c in LABEL_SOURCES))
def label_to_binary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary mapping of free-text labels with counts, whole tables."""
    parts = []
    for t, c in LABEL_SOURCES:
        df = table(spark, sf_dir, t)
        parts.append(df.groupBy(F.lit(f"{t}.{c}").alias("source"), F.col(c).cast("string").alias("label_value"),
                                label_to_binary(F.col(c)).alias("binary_label")).agg(F.count(F.lit(1)).alias("count")))
    return reduce(DataFrame.unionByName, parts)


DIST_SOURCES = (("events", "event_type"), ("orders", "o_orderstatus"), ("labels", "quality"), ("embeddings", "label"))


@query("label_distribution", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, '{c}' AS label_column, label_value, count, count / sum(count) OVER () AS percent FROM "
    f"(SELECT coalesce(CAST({c} AS VARCHAR), '<NA>') AS label_value, count(*) AS count FROM {t} GROUP BY 1)"
    for t, c in DIST_SOURCES))
def label_distribution_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-label counts and shares."""
    return reduce(DataFrame.unionByName,
                  [label_distribution(table(spark, sf_dir, t), t, c) for t, c in DIST_SOURCES])


def _missing_sql(cols) -> str:
    terms = []
    for c, kind in cols:
        cond = f"{c} IS NULL OR isnan({c})" if kind == "d" else f"{c} IS NULL"
        terms.append(f"count(*) FILTER (WHERE {cond})")
    return " + ".join(terms)


@query("table_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS rows, {len(TABLE_COLUMNS[t])} AS columns, {_missing_sql(TABLE_COLUMNS[t])} "
    f"AS missing_cells, ({_missing_sql(TABLE_COLUMNS[t])}) / (count(*) * {len(TABLE_COLUMNS[t])}) AS missing_value_ratio FROM {t}"
    for t in PROFILED))
def table_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns and missing cells of each table, one aggregate per table."""
    parts = [table_profile(table(spark, sf_dir, t), t).select("dataset", "rows", "columns", "missing_cells",
                                                            "missing_value_ratio") for t in PROFILED]
    return reduce(DataFrame.unionByName, parts)


MISSING_TABLES = PROFILED


@query("column_missing", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if k == 'd' else ''}) "
    f"AS missing, count(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if k == 'd' else ''}) / count(*) AS missing_ratio FROM {t}"
    for t in MISSING_TABLES for c, k in TABLE_COLUMNS[t]))
def column_missing_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-column missing totals."""
    return reduce(DataFrame.unionByName, [column_missing(table(spark, sf_dir, t), t) for t in MISSING_TABLES])


# --- C8-C10: empty, constant and duplicate columns --------------------------
def lineitem_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem plus columns that exercise the drop rules."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "*",
        F.col("l_quantity").alias("qty_copy"),
        F.col("l_quantity").alias("qty_copy2"),
        F.col("l_returnflag").alias("flag_copy"),
        F.col("l_tax").cast("string").alias("tax_text"),
        F.lit(1).alias("const_one"),
        F.lit(None).cast("double").alias("all_null"),
        F.when(F.col("l_linenumber") == 1, F.lit(None).cast("int")).otherwise(F.lit(1)).alias("one_or_null"),
        F.lit(0).alias("binary_label"),
    )


COPY_COLUMNS = [(c, k) for c, k in TABLE_COLUMNS["lineitem"]] + [
    ("qty_copy", "d"), ("qty_copy2", "d"), ("flag_copy", "s"), ("tax_text", "s2"), ("const_one", "i"),
    ("all_null", "d"), ("one_or_null", "i"), ("binary_label", "i")]
LINEITEM_TYPES = {"l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "i"}


def _copies_sql() -> str:
    base = """SELECT *, l_quantity AS qty_copy, l_quantity AS qty_copy2, l_returnflag AS flag_copy,
      CAST(l_tax AS VARCHAR) AS tax_text, 1 AS const_one, CAST(NULL AS DOUBLE) AS all_null,
      CASE WHEN l_linenumber = 1 THEN NULL ELSE 1 END AS one_or_null, 0 AS binary_label FROM lineitem"""
    cols = [c for c, _ in COPY_COLUMNS]
    kinds = {c: LINEITEM_TYPES.get(c, k) for c, k in COPY_COLUMNS}
    stats = ", ".join(
        f"count({c}) AS c_{c}, CAST(min({c}) AS VARCHAR) = CAST(max({c}) AS VARCHAR) AS same_{c}" for c in cols)
    pair_terms = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            if kinds[a] == kinds[b]:
                pair_terms.append(f"count(*) FILTER (WHERE {a} IS DISTINCT FROM {b}) = 0 AS eq_{a}__{b}")
    rows = []
    for i, c in enumerate(cols):
        empty = f"c_{c} = 0"
        const = "FALSE" if c == "binary_label" else f"(c_{c} = n AND same_{c})"
        earlier = [a for a in cols[:i] if kinds[a] == kinds[c]]
        # first earlier column that survives (not empty/constant/duplicate itself) and equals c
        dup_cases = " ".join(
            f"WHEN eq_{a}__{c} AND NOT (c_{a} = 0) AND NOT ({'FALSE' if a == 'binary_label' else f'(c_{a} = n AND same_{a})'}) "
            f"THEN '{a}'" for a in earlier)
        dup = f"CASE {dup_cases} ELSE NULL END" if earlier else "CAST(NULL AS VARCHAR)"
        rows.append(
            f"SELECT {i} AS ordinal, '{c}' AS column, CASE WHEN {empty} THEN 'dropped_empty' WHEN {const} THEN 'dropped_constant' "
            f"WHEN ({dup}) IS NOT NULL THEN 'dropped_duplicate' ELSE 'kept' END AS status, "
            f"CASE WHEN {empty} OR {const} THEN NULL ELSE {dup} END AS duplicate_of FROM st")
    return f"WITH src AS ({base}), st AS (SELECT count(*) AS n, {stats}, {', '.join(pair_terms)} FROM src)\n" + \
        "\nUNION ALL\n".join(rows)


@query("constant_dup_columns", _copies_sql())
def constant_dup_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-pass empty/constant/duplicate column decisions."""
    return column_drop_plan(lineitem_with_copies(spark, sf_dir))


HC_TABLES = tuple(t for t, cols in TABLE_COLUMNS.items() if cols and any(k == "s" for _, k in cols))


@query("high_cardinality", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, '{c}' AS column, count(DISTINCT {c}) AS distinct_count, "
    f"CASE WHEN count(DISTINCT {c}) > greatest(1000.0, count(*) * 0.2) THEN 'dropped_high_cardinality' ELSE 'kept' END AS status FROM {t}"
    for t in HC_TABLES for c, k in TABLE_COLUMNS[t] if k == "s"))
def high_cardinality_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts of all string columns and which are too many."""
    parts = [high_cardinality_strings(table(spark, sf_dir, t)).select(
        F.lit(t).alias("dataset"), "column", "distinct_count", "status") for t in HC_TABLES]
    return reduce(DataFrame.unionByName, parts)


@query("rare_class_filter", """
SELECT l_orderkey, l_linenumber, label FROM (
  SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS label,
         count(*) OVER (PARTITION BY l_returnflag || l_linestatus) AS n FROM lineitem)
WHERE n >= 10000
""")
def rare_class_filter_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep rows whose class has at least 10,000 rows (left-semi join)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("label"))
    return rare_class_filter(li, "label", min_count=10_000)


@query("label_encode", """
SELECT 'embeddings' AS dataset, CAST(label AS VARCHAR) AS label, CAST(dense_rank() OVER (ORDER BY CAST(label AS VARCHAR)) - 1 AS INTEGER) AS code, count
FROM (SELECT label, count(*) AS count FROM embeddings GROUP BY label)
UNION ALL
SELECT 'lineitem', label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER), count
FROM (SELECT l_returnflag || l_linestatus AS label, count(*) AS count FROM lineitem GROUP BY 1)
""")
def label_encode_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alphabetical class codes."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("label"))
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("label"))
    return reduce(DataFrame.unionByName, [
        label_codes(df, "label").select(F.lit(name).alias("dataset"), "label", "code", "count")
        for name, df in (("embeddings", emb), ("lineitem", li))])


# --- C1-C14 end to end ---------------------------------------------------------------
def raw_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw packet-capture-like rows from events (label text, time, length, client, message, per-user file)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("ts").alias("Timestamp"), F.col("value").alias("tcp.len"), F.col("event_type").alias("Label"),
        F.col("user_id").alias("Client ID"), F.col("props").alias("mqtt.msg"), F.lit(6).alias("ip.proto"),
        F.col("value").alias("frame-len"), F.lit(None).cast("double").alias("tcp.time_delta"),
        F.concat(F.lit("capture_"), F.col("event_type"), F.lit(".csv")).alias("source_file"))


@query("preprocess_packets", f"""WITH r AS (SELECT value AS tcp_len, event_type AS lbl, 'capture_' || event_type AS stem,
    CAST({sql_label_to_binary('event_type')} AS INTEGER) AS b FROM events),
f AS (SELECT stem, count(DISTINCT lbl) AS k FROM r GROUP BY stem)
SELECT b AS binary_label,
  CASE WHEN k <= 2 THEN CASE WHEN b = 0 THEN 'benign'
         WHEN contains(lower(stem), 'normal') OR contains(lower(stem), 'benign') OR contains(lower(stem), 'legit')
         THEN 'attack' ELSE stem END
       ELSE coalesce(trim(lbl), 'unknown') END AS multiclass_label, tcp_len
FROM r JOIN f USING (stem) WHERE b IS NOT NULL""")
def preprocess_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names, detected label, binary/multiclass labels, drop rules, forbidden names."""
    from flowlens.operators.clean import preprocess_table

    cleaned, _ = preprocess_table(raw_packets(spark, sf_dir), "packets")
    return cleaned


@query("preprocess_metadata", f"""WITH r AS (SELECT event_type AS lbl, CAST({sql_label_to_binary('event_type')} AS INTEGER) AS b FROM events)
SELECT 'packets' AS dataset, 'ok' AS status, count(*) AS raw_rows, 9 AS raw_columns, 3 AS cleaned_columns,
  count(*) FILTER (WHERE b IS NULL) AS dropped_missing_label_rows, 'Label' AS detected_label_column,
  'ip_proto;frame_len;tcp_time_delta;dataset_name' AS dropped_empty_constant_duplicate_columns,
  'Client_ID;Label;Timestamp;mqtt_msg;source_file' AS dropped_leakage_or_forbidden_columns, 'tcp_len' AS feature_columns FROM r""")
def preprocess_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: the metadata row of the packet cleaning job."""
    from flowlens.operators.clean import preprocess_table

    _, meta = preprocess_table(raw_packets(spark, sf_dir), "packets")
    return meta
