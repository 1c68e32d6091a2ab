"""File discovery, delimiter detection and delimited reads.

* discovery lists files with the ``binaryFile`` source restricted to path
  and length (the content column is pruned, nothing is read);
* the executors read each file's header (one small read per file);
* one distributed pass over all lines of all files gives, for each file, the
  delimiter that agrees with its header, its encoding, whether quotes span
  lines, and how many lines disagree with the header;
* files of the same layout (header, delimiter, encoding) are read together as text,
  one scan per layout, and the layouts are united by column name; columns
  whose values all parse as numbers become doubles (one aggregate).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.names import unique_columns

# fixed values: accepted suffixes, skipped names, candidate delimiters (in priority order)
DATA_SUFFIXES = (".csv", ".csv.gz", ".tsv", ".txt")
SKIP_PATH_TOKEN = "smote"
SKIP_NAME_PREFIX = "readme"
DELIMITERS = (",", ";", "\t", "|")
ARCHIVE_SUFFIX = ".zip"
BOM = "\ufeff"


def discover_files(spark: SparkSession, root: str, archives: bool = False) -> DataFrame:
    """(path, size_bytes) of data files below ``root``, sorted and de-duplicated; with ``archives`` of ZIP
    archives too, whose members ``sources.archives`` reads."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
               .select(F.col("path"), F.col("length").alias("size_bytes")))
    low = F.lower("path")
    name = F.regexp_extract(low, r"([^/]+)$", 1)
    keep = reduce(lambda a, b: a | b, [low.endswith(s) for s in (*DATA_SUFFIXES, *([ARCHIVE_SUFFIX] if archives else []))])
    return (listing.where(keep & ~low.contains(SKIP_PATH_TOKEN) & ~name.startswith(SKIP_NAME_PREFIX))
            .dropDuplicates(["path"]).orderBy("path"))


def select_variant(paths: list[str], preferred=("biflow", "uniflow")) -> tuple[list[str], str]:
    """Files of the first preferred variant present (by path token), with a note."""
    for token, note in zip(preferred, ("selected_biflow_features", "selected_uniflow_features_fallback")):
        hit = [p for p in paths if token in p.lower()]
        if hit:
            return hit, note
    return paths, "no_biflow_or_uniflow_files_found"


def open_stream(path: str):
    """A buffered binary stream of a file on any file system that pyarrow knows, unpacked if it is gzipped."""
    import gzip
    import io
    from urllib.parse import unquote, urlparse

    from pyarrow import fs as pafs

    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        filesystem, inner = pafs.LocalFileSystem(), unquote(parsed.path)
    else:
        filesystem, inner = pafs.FileSystem.from_uri(path)
    raw = filesystem.open_input_file(inner)
    return gzip.GzipFile(fileobj=raw) if path.lower().endswith(".gz") else io.BufferedReader(raw, 1 << 20)


def first_record(stream) -> str:
    """The first record of a delimited file as text: up to the first line end outside quotes."""
    raw = b""
    while True:
        line = stream.readline()
        raw += line
        if not line or (raw.count(b'"') % 2 == 0 and raw.strip()):
            break
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("latin1")
    return text.strip("\r\n")


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = []
        for path in pdf["path"]:
            with open_stream(path) as stream:
                found.append(first_record(stream))
        yield pd.DataFrame({"path": pdf["path"], "header": found})


def _same_path(path):
    """One spelling of local paths: Spark's readers differ in the number of slashes."""
    return F.regexp_replace(path, "^file:/+", "/")


def file_facts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file: path, header, sep, encoding, multiline, lines, bad_lines.

    All lines are read, in one pass that splits large files.  The delimiter is the candidate whose
    count outside quotes is that of the header, above 0, in the most lines (priority order on ties); ``.tsv``
    files are tab separated, and without any candidate it is ``,``.  A file that is not valid UTF-8 is
    latin1.  Quotes span lines if some line holds an odd number of them.  ``bad_lines`` counts the
    lines that disagree with the header; it is null where quotes span lines.
    """
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")
    headers = files.mapInPandas(_headers, "path string, header string").select(_same_path(F.col("path")).alias("key"), "path", "header")
    lines = spark.read.text(paths).select(_same_path(F.col("_metadata.file_path")).alias("key"), "value")

    def counts(text):
        bare = F.regexp_replace(text, '"[^"]*"', "")
        return [F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) for d in DELIMITERS]

    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    joined = lines.join(headers, "key").where(F.trim("value") != "")
    agree = [F.count_if((own == head) & (head > 0)).alias(f"a{i}") for i, (own, head) in enumerate(zip(counts(F.col("value")), counts(F.col("header"))))]
    facts = joined.groupBy("path").agg(F.first("header").alias("header"), F.count(F.lit(1)).alias("lines"),
                                       F.count_if(~F.is_valid_utf8("value")).alias("invalid"), F.count_if(quotes % 2 == 1).alias("odd"), *agree)
    best = F.greatest(*[F.col(f"a{i}") for i in range(len(DELIMITERS))])
    sep = F.lit(",")
    for i, d in reversed(list(enumerate(DELIMITERS))):
        sep = F.when((best > 0) & (F.col(f"a{i}") == best), F.lit(d)).otherwise(sep)
    sep = F.when(F.lower("path").rlike(r"\.tsv(\.gz)?$"), F.lit("\t")).otherwise(sep)
    of_sep = reduce(lambda out, i: F.when(F.col("sep") == DELIMITERS[i], F.col(f"a{i}")).otherwise(out), range(len(DELIMITERS)), F.lit(0))
    facts = facts.withColumn("sep", sep)
    return facts.select("path", "header", "sep", F.when(F.col("invalid") > 0, "ISO-8859-1").otherwise("UTF-8").alias("encoding"),
                        (F.col("odd") > 0).alias("multiline"), "lines",
                        F.when((F.col("odd") == 0) & F.col("header").contains(F.col("sep")), F.col("lines") - of_sep).alias("bad_lines"))


def sniff_delimiters(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Delimiter per file, decided from all of its lines (one row per file reaches the driver)."""
    found = {r["path"]: r["sep"] for r in file_facts(spark, paths).collect()} if paths else {}
    return {p: found.get(p, ",") for p in paths}


def coerce_numeric_columns(df: DataFrame, keep=("source_file", "dataset_name")) -> DataFrame:
    """Text columns whose every non-null value parses as a number become doubles (one aggregate pass),
    the rule a pandas reader applies; other columns stay text, no value is lost."""
    from flowlens.functions.numeric import NUMBER_PATTERN

    text_cols = [c for c, t in df.dtypes if t == "string" and c not in keep]
    if not text_cols:
        return df
    trimmed = {c: F.trim(F.col(c)) for c in text_cols}
    row = df.agg(*[x for i, c in enumerate(text_cols) for x in (
        F.count_if(trimmed[c].isNotNull() & (trimmed[c] != "")).alias(f"n{i}"),
        F.count_if(F.lower(trimmed[c]).rlike(NUMBER_PATTERN)).alias(f"p{i}"))]).first()
    numeric = {c for i, c in enumerate(text_cols) if row[f"n{i}"] > 0 and row[f"n{i}"] == row[f"p{i}"]}
    return df.select(*[F.regexp_replace(F.lower(F.trim(F.col(c))), "_", "").try_cast("double").alias(c)
                       if c in numeric else F.col(c) for c in df.columns])


def read_delimited(spark: SparkSession, paths: list[str], dataset: str | None = None, seps: dict[str, str] | None = None,
                   coerce_numbers: bool = True) -> DataFrame:
    """Read files layout by layout (header, delimiter, encoding, quoting), normalise column names, add provenance,
    unite by name, then turn all-numeric columns into doubles.

    Each file's values land under its own header's names, whatever the order of its columns.  Lines
    with fewer fields than the header are filled with nulls and extra fields are dropped; a warning
    tells how many lines of which files disagree.  ``seps`` overrides the delimiters.  Files without any
    line have no columns and are left out.
    """
    import csv

    layouts: dict[tuple, list[str]] = {}
    for r in file_facts(spark, paths).collect():  # one row per file
        sep = (seps or {}).get(r["path"], r["sep"])
        if r["bad_lines"]:
            warnings.warn(f"{r['path']}: {r['bad_lines']} of {r['lines']} lines disagree with the header", stacklevel=2)
        names = tuple(next(csv.reader([r["header"]], delimiter=sep), []))
        layouts.setdefault((names, sep, r["encoding"], r["multiline"]), []).append(r["path"])
    frames = []
    for (names, sep, encoding, multiline), group in sorted(layouts.items()):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in unique_columns(list(names))])
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep).option("encoding", encoding)
              .option("multiLine", multiline).option("escape", '"').option("mode", "PERMISSIVE").csv(sorted(group)))
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
        if dataset is not None:
            df = df.withColumn("dataset_name", F.lit(dataset))
        frames.append(df)
    if not frames:
        raise ValueError("no file with a header")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return coerce_numeric_columns(df) if coerce_numbers else df


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet when the suffix says so, else a delimited file."""
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    return read_delimited(spark, [path])
