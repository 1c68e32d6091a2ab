"""Column and row cleaning.

Empty, constant and duplicate columns are decided from one aggregate over
the table; candidate duplicate pairs (same type, same non-null count, same
order-independent hash digest) are then verified exactly in a second pass
that only reads the candidate columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.names import norm
from flowlens.operators.ranked import numbered, small_side
from flowlens.vocab import FORBIDDEN_MAIN_FEATURE_TOKENS, LEAKAGE_TOKENS, RAW_CONTENT_EXACT, TEMPORAL_LEAKAGE_EXACT

KEEP_LABELS = ("binary_label", "multiclass_label")


def column_drop_plan(df: DataFrame, exempt=KEEP_LABELS) -> DataFrame:
    """Per column: kept / dropped_empty / dropped_constant / dropped_duplicate (+ duplicate_of).

    ``exempt`` columns (the labels) are never dropped (C11).  Returns a small
    DataFrame (one row per column).
    """
    spark = df.sparkSession
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [F.count(x).alias(f"c{i}"), F.min(x).cast("string").alias(f"lo{i}"), F.max(x).cast("string").alias(f"hi{i}"),
                 F.sum(F.xxhash64(x).cast("decimal(38,0)")).alias(f"h{i}")]
    stats = df.agg(*aggs).first()
    n = stats["__n"]
    status: dict[str, str] = {}
    dup_of: dict[str, str] = {}
    for i, c in enumerate(cols):
        cnt = stats[f"c{i}"]
        if c in exempt:
            continue
        if cnt == 0:
            status[c] = "dropped_empty"
        elif c not in exempt and cnt == n and stats[f"lo{i}"] == stats[f"hi{i}"]:
            status[c] = "dropped_constant"
    # exact duplicate check for same-typed columns with equal digests
    survivors = [c for c in cols if c not in status]
    dtypes = dict(df.dtypes)
    groups: dict[tuple, list[str]] = {}
    for c in survivors:
        i = cols.index(c)
        groups.setdefault((dtypes[c], stats[f"c{i}"], stats[f"h{i}"]), []).append(c)
    pairs = [(g[0], other) for g in groups.values() if len(g) > 1 for other in g[1:]]
    if pairs:
        check = df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).first()
        for k, (a, b) in enumerate(pairs):
            if check[f"p{k}"] == 0 and b not in status and b not in exempt:
                status[b] = "dropped_duplicate"
                dup_of[b] = a
    rows = [(i, c, status.get(c, "kept"), dup_of.get(c)) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "ordinal int, column string, status string, duplicate_of string")


def drop_by_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    dropped = [r["column"] for r in plan.where(F.col("status") != "kept").select("column").collect()]
    return df.drop(*dropped)


def forbidden_columns(columns: list[str], keep=KEEP_LABELS) -> list[str]:
    """Leakage tokens, forbidden tokens, exact content/time names (labels kept)."""
    out = []
    for c in columns:
        low = norm(c)
        if c in keep:
            continue
        if any(t in low for t in LEAKAGE_TOKENS) or any(t in low for t in FORBIDDEN_MAIN_FEATURE_TOKENS) \
                or low in RAW_CONTENT_EXACT or low in TEMPORAL_LEAKAGE_EXACT or c in ("dataset_name", "source_file"):
            out.append(c)
    return sorted(out)


def high_cardinality_strings(df: DataFrame, min_distinct: int = 1000, share: float = 0.2, keep=KEEP_LABELS) -> DataFrame:
    """String columns whose distinct count exceeds max(min_distinct, share * rows).

    Counts are exact and those of all columns come from one job: the (column, value) pairs are made distinct on the map side,
    then by a shuffle on the pair, so neither a column nor a frequent value is one task.
    """
    spark = df.sparkSession
    strings = [c for c, t in df.dtypes if t == "string" and c not in keep]
    if not strings:
        return spark.createDataFrame([], "column string, distinct_count long, bound double, status string")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in strings]))
    found = df.select(pairs.alias("p")).where("p.value IS NOT NULL").select("p.column", "p.value").distinct()
    counts = {r["column"]: r["n"] for r in found.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = max(float(min_distinct), df.count() * share)
    rows = [(c, counts.get(c, 0), bound, "dropped_high_cardinality" if counts.get(c, 0) > bound else "kept") for c in strings]
    return spark.createDataFrame(rows, "column string, distinct_count long, bound double, status string")


def rare_class_filter(df: DataFrame, label: str, min_count: int = 3) -> DataFrame:
    """Rows whose label occurs at least ``min_count`` times (left-semi join on the kept labels, which are broadcast if
    they are few, so rows are not shuffled on the label)."""
    kept = df.groupBy(label).count().where(F.col("count") >= min_count).select(label)
    return df.join(small_side(kept), on=label, how="left_semi")


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Alphabetical integer codes of the distinct labels (0-based, null first)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return numbered(counts, [F.col(label).cast("string").asc_nulls_first()], "code").withColumn("code", F.col("code").cast("int"))


def encode_labels(df: DataFrame, label: str, codes: DataFrame) -> DataFrame:
    """Attach codes (one row per class, broadcast if they are few)."""
    return df.join(small_side(codes.select(label, "code")), on=label, how="inner")


def preprocess_table(df: DataFrame, dataset: str, file_col: str = "source_file", label_column: str | None = None,
                     flow_metadata: bool = False, min_label_score: int = 1) -> tuple[DataFrame, DataFrame]:
    """The cleaning job for one dataset (C1-C14): returns (cleaned table, one metadata row).

    Names are normalised; the label column is detected (or taken from the
    file name); rows whose label maps to nothing are dropped and counted per
    file; a two-valued label becomes benign / the file's attack name;
    empty, constant and duplicate columns, leakage/forbidden names and
    high-cardinality strings are dropped (labels exempt); optionally the
    common flow metadata are added (F5).  ``min_label_score=1`` keeps the
    original detection, where any low-cardinality column can become the
    label; 3 requires a label-like name and otherwise labels come from the
    file names.
    """
    from flowlens.functions.labels import label_from_filename, label_to_binary
    from flowlens.functions.names import unique_columns
    from flowlens.operators.flow import add_flow_metadata
    from flowlens.operators.profile import detect_label_column

    spark = df.sparkSession
    raw_cols = len(df.columns)
    df = df.toDF(*unique_columns(df.columns))
    if file_col not in df.columns:
        df = df.withColumn(file_col, F.lit(dataset))
    label = label_column or detect_label_column(df.drop(file_col), min_score=min_label_score)
    raw = F.col(label) if label else label_from_filename(F.col(file_col))
    work = df.withColumn("binary_label", label_to_binary(raw)).withColumn("__raw_label", raw.cast("string"))
    per_file = work.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(F.col("binary_label").isNull()).alias("dropped_missing_label_rows"),
        F.count_distinct("__raw_label").alias("label_values"))
    work = work.where(F.col("binary_label").isNotNull())
    # per-file table (one row per file): two-valued labels become benign / the file's attack name
    fname = label_from_filename(F.col(file_col))
    two_valued = F.col("label_values") <= 2
    multi = F.when(two_valued & F.lit(label is not None),
                   F.when(F.col("binary_label") == 0, F.lit("benign"))
                   .otherwise(F.when(fname == "benign", F.lit("attack")).otherwise(fname))) \
        .otherwise(F.coalesce(F.trim("__raw_label"), F.lit("unknown")))
    work = (work.join(per_file.select(file_col, "label_values"), file_col)
            .withColumn("multiclass_label", multi).drop("label_values", "__raw_label")
            .withColumn("dataset_name", F.lit(dataset)))
    # labels first (so a raw label column equal to them is the duplicate that goes)
    work = work.select(*KEEP_LABELS, *[c for c in work.columns if c not in KEEP_LABELS])
    plan = column_drop_plan(work)
    structural = [r["column"] for r in plan.where(F.col("status") != "kept").collect()]
    work = work.drop(*structural)
    forbidden = forbidden_columns(work.columns)
    work = work.drop(*forbidden)
    if flow_metadata:
        work = add_flow_metadata(work, mode="common")
    high = [r["column"] for r in high_cardinality_strings(work).where(F.col("status") != "kept").collect()]
    work = work.drop(*high)
    ordered = ["binary_label", "multiclass_label", *[c for c in work.columns if c not in KEEP_LABELS]]
    work = work.select(*ordered)
    meta = per_file.agg(F.sum("raw_rows").alias("raw_rows"),
                        F.sum("dropped_missing_label_rows").alias("dropped_missing_label_rows")).select(
        F.lit(dataset).alias("dataset"), F.lit("ok").alias("status"), "raw_rows", F.lit(raw_cols).alias("raw_columns"),
        F.lit(len(ordered)).alias("cleaned_columns"), "dropped_missing_label_rows",
        F.lit(label).cast("string").alias("detected_label_column"),
        F.lit(";".join(c for c in structural)).alias("dropped_empty_constant_duplicate_columns"),
        F.lit(";".join(sorted(set(forbidden) | set(high)))).alias("dropped_leakage_or_forbidden_columns"),
        F.lit(";".join(c for c in ordered if c not in KEEP_LABELS)).alias("feature_columns"))
    return work, meta
