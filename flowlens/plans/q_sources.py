"""Source queries: Zeek logs (S7, F6-F8, C19, O2), pages (S12, S13), delimited files (S1-S3, S5, S9), manifest."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.flow import history_column
from flowlens.operators.profile import detect_label_column
from flowlens.plans.registry import query, table
from flowlens.session import scratch_path
from flowlens.sources.archives import archive_name, read_members, write_zip, zip_members
from flowlens.sources.files import discover_files, read_delimited, sniff_delimiters
from flowlens.sources.manifest import file_digests, verify_manifest
from flowlens.sources.pages import absolute_url, folder_links, listing_rows, page_links
from flowlens.sources.zeek import parse_zeek, read_zeek_lines, zeek_flows
from flowlens.vocab import LABEL_EXACT, LABEL_TOKENS, ZEEK_HISTORY_CHARS, ZEEK_NUMERIC_COLUMNS

ZEEK_FIELDS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration",
               "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp", "missed_bytes", "history",
               "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", "tunnel_parents", "label", "detailed-label"]
ZEEK_LOGS = 16


def zeek_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in Zeek logs from events, written as text files: one log per group of users, a '#fields' header, one line per event
    (purchases with k > 90 carry an extra token, i.e. a malformed line)."""
    # the JSON field is extracted once into a column, then referenced by the line expressions
    ev = table(spark, sf_dir, "events").withColumn("_k", F.get_json_object("props", "$.k"))
    k = F.col("_k")
    et = F.col("event_type")
    fields = [
        F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.concat(F.lit("C"), F.col("event_id").cast("string")),
        F.concat(F.lit("10.0."), F.col("user_id").cast("string")), k, F.lit("192.168.1.1"), F.lit("1883"),
        F.when(et == "error", "udp").when(et == "signup", "icmp").otherwise("tcp"),
        F.when(et == "view", "http").otherwise("-"),
        F.when(et == "signup", "-").otherwise((F.col("value") / 10).cast("string")),
        F.floor(F.col("value") * 10).cast("long").cast("string"),
        F.when(et == "purchase", "-").otherwise(k),
        F.when(et == "error", "S0").when(et == "click", "REJ").otherwise("SF"),
        F.lit("-"), F.lit("-"), F.lit("0"),
        F.when(et == "click", "ShAdDaFf").when(et == "view", "S").when(et == "error", "-").when(et == "signup", "ShR^r")
        .otherwise("DdAaHhIQ"),
        F.col("user_id").cast("string"), (F.col("user_id") * 40).cast("string"), k,
        F.when(et == "purchase", "(empty)").otherwise((k.cast("long") * 40).cast("string")),
        F.lit("-"),
        F.when(et == "error", "Malicious").otherwise("Benign"),
        F.when((et == "error") & (F.col("value") > 250), "PartOfAHorizontalPortScan").otherwise("-"),
    ]
    line = F.concat_ws("\t", *fields)
    line = F.when((et == "purchase") & (k.cast("long") > 90), F.concat(line, F.lit("\textra"))).otherwise(line)
    log = F.concat(F.lit("zeek_conn_u"), F.lpad((F.col("user_id") % ZEEK_LOGS).cast("string"), 2, "0"), F.lit(".log.labeled"))
    data = ev.select(log.alias("log"), (F.col("event_id") + 2).alias("line_no"), line.alias("value"))
    files = spark.range(ZEEK_LOGS).select(F.concat(F.lit("zeek_conn_u"), F.lpad(F.col("id").cast("string"), 2, "0"), F.lit(".log.labeled")).alias("log"))
    heads = files.select("log", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), F.lit("#separator \\x09").alias("value")),
        F.struct(F.lit(1).cast("long").alias("line_no"), F.lit("#fields\t" + "\t".join(ZEEK_FIELDS)).alias("value")),
    )).alias("h")).select("log", "h.line_no", "h.value")
    root = scratch_path(spark, f"zeek/{uuid.uuid4().hex}")
    lines = heads.unionByName(data).repartition(ZEEK_LOGS, "log").sortWithinPartitions("log", "line_no")
    lines.select("log", "value").write.partitionBy("log").text(root)
    read = read_zeek_lines(spark, root)
    return read.withColumn("source_file", F.regexp_extract("source_file", r"log=([^/]+)/", 1))


ZEEK_LINES_SQL = """
WITH ev AS (SELECT *, json_extract_string(props, '$.k') AS k,
    'zeek_conn_u' || lpad(CAST(user_id % """ + str(ZEEK_LOGS) + """ AS VARCHAR), 2, '0') || '.log.labeled' AS source_file FROM events),
dl AS (SELECT source_file, event_id + 2 AS line_no, concat_ws(chr(9),
    CAST(epoch_us(ts) AS VARCHAR), 'C' || CAST(event_id AS VARCHAR), '10.0.' || CAST(user_id AS VARCHAR), k,
    '192.168.1.1', '1883',
    CASE WHEN event_type = 'error' THEN 'udp' WHEN event_type = 'signup' THEN 'icmp' ELSE 'tcp' END,
    CASE WHEN event_type = 'view' THEN 'http' ELSE '-' END,
    CASE WHEN event_type = 'signup' THEN '-' ELSE CAST(value / 10 AS VARCHAR) END,
    CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR),
    CASE WHEN event_type = 'purchase' THEN '-' ELSE k END,
    CASE WHEN event_type = 'error' THEN 'S0' WHEN event_type = 'click' THEN 'REJ' ELSE 'SF' END,
    '-', '-', '0',
    CASE WHEN event_type = 'click' THEN 'ShAdDaFf' WHEN event_type = 'view' THEN 'S' WHEN event_type = 'error' THEN '-'
         WHEN event_type = 'signup' THEN 'ShR^r' ELSE 'DdAaHhIQ' END,
    CAST(user_id AS VARCHAR), CAST(user_id * 40 AS VARCHAR), k,
    CASE WHEN event_type = 'purchase' THEN '(empty)' ELSE CAST(CAST(k AS BIGINT) * 40 AS VARCHAR) END,
    '-', CASE WHEN event_type = 'error' THEN 'Malicious' ELSE 'Benign' END,
    CASE WHEN event_type = 'error' AND value > 250 THEN 'PartOfAHorizontalPortScan' ELSE '-' END)
    || CASE WHEN event_type = 'purchase' AND CAST(k AS BIGINT) > 90 THEN chr(9) || 'extra' ELSE '' END AS value
  FROM ev),
lines AS (SELECT * FROM dl UNION ALL
  SELECT DISTINCT source_file, CAST(1 AS BIGINT) AS line_no, '#fields' || chr(9) || '""" + "' || chr(9) || '".join(ZEEK_FIELDS) + """' AS value FROM ev)"""


def _zeek_sql() -> str:
    def fld(name: str) -> str:
        return f"parts[list_position(fields, '{name}')]"

    def clean(name: str) -> str:
        return f"CASE WHEN {fld(name)} IN ('-', '(empty)', '') THEN NULL ELSE {fld(name)} END"

    nums = ", ".join(f"TRY_CAST({clean(c)} AS DOUBLE) AS {c}" for c in ZEEK_NUMERIC_COLUMNS)
    hist = ", ".join(
        f"length(coalesce({fld('history')}, '')) - length(replace(coalesce({fld('history')}, ''), '{ch}', '')) AS "
        + history_column(ch) for ch in ZEEK_HISTORY_CHARS)
    low = f"lower(trim(coalesce({fld('label')}, '')))"
    det = f"trim({fld('detailed-label')})"
    return ZEEK_LINES_SQL + f""",
sl AS (SELECT source_file, line_no, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS value FROM lines),
hdr AS (SELECT source_file, arg_max(string_split_regex(regexp_replace(regexp_replace(value, '^#fields', ''), '^\\s+|\\s+$', '', 'g'), '\\s+'), line_no) AS fields
        FROM sl WHERE starts_with(value, '#fields') GROUP BY source_file),
dat AS (SELECT source_file, line_no, string_split_regex(value, '\\s+') AS parts FROM sl
        WHERE value <> '' AND NOT starts_with(value, '#')),
j AS (SELECT d.*, h.fields FROM dat d JOIN hdr h USING (source_file) WHERE len(d.parts) = len(h.fields)),
r AS (SELECT line_no, CASE WHEN contains({low}, 'benign') THEN 0 ELSE 1 END AS binary_label,
        CASE WHEN contains({low}, 'benign') THEN 'benign'
             WHEN {det} IS NOT NULL AND {det} <> '' AND {det} <> '-' THEN {det} ELSE {low} END AS multiclass_label,
        source_file, {nums},
        {clean('proto')} AS proto, {clean('service')} AS service, {clean('conn_state')} AS conn_state,
        length(coalesce({fld('history')}, '')) AS history_len, {hist}
      FROM j WHERE {low} <> ''),
t AS (SELECT *, coalesce(orig_bytes, 0.0) + coalesce(resp_bytes, 0.0) AS total_bytes,
             coalesce(orig_pkts, 0.0) + coalesce(resp_pkts, 0.0) AS total_pkts FROM r),
u AS (SELECT *, CASE WHEN duration IS NOT NULL AND duration > 0 THEN total_bytes / duration ELSE 0.0 END AS bytes_per_second,
             CASE WHEN duration IS NOT NULL AND duration > 0 THEN total_pkts / duration ELSE 0.0 END AS packets_per_second FROM t)
"""


@query("zeek_flows", _zeek_sql() + "SELECT * EXCLUDE (line_no) FROM u")
def zeek_flows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + F6-F8 + C19: parse Zeek logs, derive features and labels of every labelled flow."""
    return zeek_flows(parse_zeek(zeek_lines(spark, sf_dir))).withColumn(
        "history_len", F.col("history_len").cast("long"))


@query("page_links", """SELECT page_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS link_no, unnest(arr) AS href
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS arr FROM pages)""")
def page_links_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every stored page."""
    links = page_links(table(spark, sf_dir, "pages"))
    return links.withColumn("link_no", F.col("link_no").cast("long"))


@query("listing_rows", """WITH r AS (
  SELECT page_id, CAST(generate_subscripts(rows, 1) - 1 AS BIGINT) AS row_no, unnest(rows) AS row_html
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS rows FROM pages)),
l AS (SELECT page_id, row_no, trim(regexp_replace(regexp_replace(row_html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS row_text,
        unnest(regexp_extract_all(row_html, 'href="([^"]+)"', 1)) AS href FROM r)
SELECT page_id, row_no, row_text, href, CAST(NULL AS BIGINT) AS size_bytes,
  contains(lower(href), 'labeled') AND (contains(lower(href), 'zeek-conn') OR contains(lower(href), 'conn.log')) AS is_candidate
FROM l""")
def listing_rows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows (<li>) with their links, tag-free text, trailing size and log-candidate flag."""
    rows = listing_rows(table(spark, sf_dir, "pages"), row_tag="li")
    return rows.withColumn("row_no", F.col("row_no").cast("long"))


@query("csv_roundtrip", """SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props, 'events' AS dataset_name
FROM events""")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as ';'-separated text next to a README and a 'smote' file, then
    discovered, delimiter-sniffed and read back with provenance columns."""
    root = scratch_path(spark, f"csv_roundtrip/{uuid.uuid4().hex}")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    ev.write.option("header", True).option("sep", ";").option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS") \
        .csv(os.path.join(root, "events"))
    ev.limit(5).write.option("header", True).csv(os.path.join(root, "events_smote"))
    spark.createDataFrame([("see the files",)], "t string").write.text(os.path.join(root, "readme_dir"))
    files = [r["path"] for r in discover_files(spark, root).collect()]  # a file listing (one row per file)
    df = read_delimited(spark, files, dataset="events", seps=sniff_delimiters(spark, files))
    return df.select(F.col("event_id").cast("long").alias("event_id"),
                     F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                     F.col("user_id").cast("long").alias("user_id"), "event_type", "value", "props", "dataset_name")


@query("csv_union", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'bom' WHEN 1 THEN 'latin' ELSE 'plain' END AS layout,
  CASE WHEN doc_id % 3 = 1 THEN 'é-' || lang ELSE lang END AS lang, CASE WHEN doc_id % 3 > 0 THEN source END AS source,
  CASE WHEN doc_id % 3 <> 1 THEN md5(text) END AS text_md5 FROM documents""")
def csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to three layouts - other column sets and orders, ',' and ';', a byte-order mark,
    latin1, quoted line breaks - and read back as one table, by column name."""
    root = scratch_path(spark, f"csv_union/{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    part = F.col("doc_id") % 3
    plain = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.where(part == 0).select(F.col("doc_id").alias("\ufeffdoc_id"), "lang", "text").write.options(**plain).csv(f"{root}/bom")
    latin = docs.where(part == 1).select(F.concat(F.lit("é-"), "lang").alias("lang"), "doc_id", "source")
    latin.write.options(**plain | {"sep": ";", "encoding": "ISO-8859-1"}).csv(f"{root}/latin")
    docs.where(part == 2).select("source", "text", "doc_id", "lang").write.options(**plain).csv(f"{root}/plain")
    files = [r["path"] for r in discover_files(spark, root).collect()]
    df = read_delimited(spark, files)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract("source_file", r"/(bom|latin|plain)/[^/]+$", 1).alias("layout"),
                     "lang", "source", F.md5("text").alias("text_md5"))


@query("zip_members", """SELECT 'docs_' || source || '.zip' AS archive, lang || '/part.csv' AS member, doc_id, md5(text) AS text_md5, 0 AS extra
FROM documents""")
def zip_members_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to ZIP archives, one per source (large ones in several files) and one member per language (all members have the
    same base name; texts hold delimiters, quotes and line breaks), then read back record by record."""
    folder = scratch_path(spark, f"zips/{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs_"), "source", F.lit(".zip")).alias("archive"), F.concat("lang", F.lit("/part.csv")).alias("member"),
        F.col("doc_id").alias("order"), F.array(F.col("doc_id").cast("string"), "text").alias("line"))
    write_zip(docs, folder, ["doc_id", "text"]).collect()  # one row per file
    rows = read_members(zip_members(spark, folder))
    return rows.select(archive_name(F.col("archive")).alias("archive"), "member", F.col("fields")["doc_id"].cast("long").alias("doc_id"),
                       F.md5(F.col("fields")["text"]).alias("text_md5"), "extra")


DETECT_TABLES = {"embeddings": {"vec_id": True, "label": True}, "events": {"event_id": True, "ts": False, "user_id": True, "event_type": False, "value": True, "props": False},
                 "labels": {"doc_id": True, "quality": True, "toxic": True},
                 "orders": {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "o_orderdate": False, "o_orderpriority": False}}


def _detect_sql() -> str:
    """Names and points of every column, counted over the whole tables."""
    exact = "[" + ", ".join(f"'{n}'" for n in LABEL_EXACT) + "]"
    tokens = "|".join(LABEL_TOKENS)
    columns = " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, '{c}' AS c, {str(numeric).lower()} AS numeric, count(DISTINCT {c}) AS n FROM {t}"
        for t, cols in DETECT_TABLES.items() for c, numeric in cols.items())
    return f"""WITH c AS ({columns}),
p AS (SELECT dataset, c, coalesce(list_position({exact}, lower(c)), 0) AS place,
  CASE WHEN regexp_matches(lower(c), '{tokens}') THEN 3 ELSE 0 END + CASE WHEN n BETWEEN 2 AND 50 THEN 1 ELSE 0 END
  + CASE WHEN numeric AND n <= 5 THEN 1 ELSE 0 END AS points FROM c),
r AS (SELECT dataset, c, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN place > 0 THEN place ELSE 1000 END, points DESC, c) AS k
  FROM p WHERE place > 0 OR points >= 1)
SELECT dataset, c AS label_column FROM r WHERE k = 1"""


@query("label_column_detect", _detect_sql())
def label_column_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label column of each table (exact label names first, else name and cardinality points over all rows;
    equal points go to the smaller name)."""
    rows = [(t, detect_label_column(table(spark, sf_dir, t).drop("embedding"))) for t in DETECT_TABLES]
    return spark.createDataFrame(rows, "dataset string, label_column string")


@query("manifest_check", """WITH f AS (SELECT lang, string_agg(CAST(doc_id AS VARCHAR) || ' ' || md5(text), chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents GROUP BY lang)
SELECT lang AS name, CAST(length(body) AS BIGINT) AS size_bytes, sha256(body) AS sha256,
  CASE lang WHEN 'de' THEN 'size_mismatch' WHEN 'es' THEN 'hash_mismatch' WHEN 'fr' THEN 'unexpected' ELSE 'ok' END AS status FROM f
UNION ALL SELECT 'xx', NULL, NULL, 'missing'""")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and SHA-256 of stored files against a manifest.  One file per language lists its documents' digests;
    the manifest is right for some, asks for a larger file or another hash for others, lacks one and has one too many."""
    root = scratch_path(spark, f"manifest/{uuid.uuid4().hex}")
    lines = table(spark, sf_dir, "documents").select("lang", "doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), F.md5("text")).alias("value"))
    lines.repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", "value").write.partitionBy("lang").text(root)
    found = file_digests(spark, root, "*.txt", name_pattern=r"lang=([^/]+)/[^/]*$")
    sizes = found.where("name <> 'fr'").select("name", "size_bytes", "sha256")
    expected = sizes.select("name", F.when(F.col("name") == "de", F.col("size_bytes") * 2).otherwise(F.col("size_bytes")).alias("expected_size"),
                            F.when(F.col("name") == "es", F.repeat(F.lit("0"), 64)).otherwise(F.col("sha256")).alias("expected_sha256"))
    one_more = spark.range(1).select(F.lit("xx").alias("name"), F.lit(1).cast("long").alias("expected_size"), F.lit(None).cast("string").alias("expected_sha256"))
    return verify_manifest(found, expected.unionByName(one_more)).select("name", "size_bytes", "sha256", "status")


@query("listing_sizes", """WITH l AS (SELECT page_id, url, page_id % 900 AS k FROM pages),
x AS (SELECT page_id, url, 'log_' || CAST(k AS VARCHAR) || '/zeek-conn.labeled' AS href, CAST(floor((k + 0.5) * 1024) AS BIGINT) AS size_bytes, true AS is_candidate, false AS folder FROM l
  UNION ALL SELECT page_id, url, '/top/' || CAST(k AS VARCHAR) || '.txt', k * 1048576, false, false FROM l
  UNION ALL SELECT page_id, url, 'sub' || CAST(k AS VARCHAR) || '/', NULL, false, true FROM l
  UNION ALL SELECT page_id, url, '../', NULL, false, false FROM l)
SELECT page_id, href, size_bytes, is_candidate, folder, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href
  ELSE regexp_extract(url, '^(.*/)', 1) || href END AS address FROM x""")
def listing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder listings with sizes, one for each stored page's address: rows, sizes in bytes, candidate logs,
    folder links and absolute addresses."""
    k = (F.col("page_id") % 900).cast("string")
    body = F.concat(F.lit('<ul><li><a href="log_'), k, F.lit('/zeek-conn.labeled">log</a> '), k, F.lit('.5K</li><li><a href="/top/'), k,
                    F.lit('.txt">t</a> '), k, F.lit('M</li><li><a href="sub'), k, F.lit('/">sub</a> -</li><li><a href="../">up</a></li></ul>'))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", body.alias("html"))
    rows = listing_rows(pages)
    inside = folder_links(rows).select("page_id", "row_no", F.lit(True).alias("folder"))
    found = rows.join(pages.select("page_id", "url"), "page_id").join(inside, ["page_id", "row_no"], "left")
    return found.select("page_id", "href", "size_bytes", "is_candidate", F.coalesce("folder", F.lit(False)).alias("folder"),
                        absolute_url(F.col("url"), F.col("href")).alias("address"))


ZEEK_FLOW_SQL = _zeek_sql()
ZEEK_PARSED_SQL = ZEEK_FLOW_SQL


@query("zeek_profile", ZEEK_PARSED_SQL + """
SELECT 'zeek' AS dataset, count(*) AS rows, 31 AS columns,
  CAST(sum((duration IS NULL)::INT + (orig_bytes IS NULL)::INT + (resp_bytes IS NULL)::INT + (orig_pkts IS NULL)::INT
      + (resp_pkts IS NULL)::INT + (orig_ip_bytes IS NULL)::INT + (resp_ip_bytes IS NULL)::INT + (missed_bytes IS NULL)::INT
      + (proto IS NULL)::INT + (service IS NULL)::INT + (conn_state IS NULL)::INT) AS BIGINT) AS missing_cells,
  CAST(sum((duration IS NULL)::INT + (orig_bytes IS NULL)::INT + (resp_bytes IS NULL)::INT + (orig_pkts IS NULL)::INT
      + (resp_pkts IS NULL)::INT + (orig_ip_bytes IS NULL)::INT + (resp_ip_bytes IS NULL)::INT + (missed_bytes IS NULL)::INT
      + (proto IS NULL)::INT + (service IS NULL)::INT + (conn_state IS NULL)::INT) AS DOUBLE) / (count(*) * 31) AS missing_value_ratio
FROM u""")
def zeek_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns and missing cells of all parseable labelled Zeek flows (before the per-class caps)."""
    from flowlens.operators.profile import table_profile

    flows = zeek_flows(parse_zeek(zeek_lines(spark, sf_dir)), max_per_class=None)
    return table_profile(flows, "zeek").select("dataset", "rows", "columns", "missing_cells", "missing_value_ratio")


@query("zeek_label_mapping", ZEEK_PARSED_SQL + """
SELECT lower(trim(lbl)) AS observed_label, binary_label, multiclass_label, count(*) AS count,
  count(*) >= 50 AS include_in_main_multiclass
FROM (SELECT u.*, r2.lbl FROM u JOIN (SELECT line_no, source_file, parts[list_position(fields, 'label')] AS lbl FROM j) r2
      USING (line_no, source_file)) GROUP BY ALL""")
def zeek_label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed label -> binary and multiclass label with counts; classes with >= 50 rows kept for multiclass."""
    parsed = parse_zeek(zeek_lines(spark, sf_dir))
    flows = zeek_flows(parsed.withColumn("observed_label", F.lower(F.trim("label"))), max_per_class=None)
    return flows.groupBy("observed_label", "binary_label", "multiclass_label").agg(F.count(F.lit(1)).alias("count")) \
        .withColumn("include_in_main_multiclass", F.col("count") >= 50)
