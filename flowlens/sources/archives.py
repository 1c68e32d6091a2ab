"""CSV members of ZIP archives as rows (S4), without extracting to local disk.

The executors list each archive's members from its directory; the (archive,
member) pairs are then dealt out, so one large archive is read by many tasks.  A
task seeks to its member, reads it twice as a stream - once to decide encoding
and delimiter from all of its lines, once to parse - and never holds it whole.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.names import unique_columns
from flowlens.operators.ranked import small_side
from flowlens.session import tasks_for
from flowlens.sources.files import DATA_SUFFIXES, DELIMITERS, SKIP_NAME_PREFIX, SKIP_PATH_TOKEN, open_stream

BATCH_ROWS, BATCH_CHARS = 5_000, 16 << 20
PART_ROWS, PART_BYTES = 4_000, 16 << 20
RECORDS = "archive string, member string, row_no long, fields map<string,string>, extra int"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path in pdf["path"]:
            with open_stream(path) as raw, zipfile.ZipFile(raw) as archive:
                for info in archive.infolist():
                    low = info.filename.lower()
                    skip = info.is_dir() or SKIP_PATH_TOKEN in low or low.rsplit("/", 1)[-1].startswith(SKIP_NAME_PREFIX)
                    if not skip and low.endswith(DATA_SUFFIXES) and not low.endswith(".gz"):
                        out.append((path, info.filename, info.file_size))
        yield pd.DataFrame(out, columns=["archive", "member", "size_bytes"])


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size_bytes) of the delimited members of every ``.zip`` below ``path``; the full path inside the
    archive names a member.  Only paths are listed; contents stay unread."""
    archives = (spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True)
                .load(path).select("path"))
    return archives.mapInPandas(_members, "archive string, member string, size_bytes long")


def member_layout(stream) -> tuple[str, str]:
    """(encoding, delimiter) of a member from all of its lines: latin1 if it is not UTF-8; the delimiter that has the
    header's count, above 0, in the most lines."""
    encoding, header, agree = "utf-8-sig", None, [0] * len(DELIMITERS)
    for raw in stream:
        try:
            line = raw.decode("utf-8")
        except UnicodeDecodeError:
            encoding, line = "latin1", raw.decode("latin1")
        if not line.strip():
            continue
        bare = "".join(line.split('"')[::2])
        counts = [bare.count(d) for d in DELIMITERS]
        header = counts if header is None else header
        agree = [a + (c == h > 0) for a, c, h in zip(agree, counts, header)]
    return encoding, DELIMITERS[agree.index(max(agree))] if any(agree) else ","


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive", "member", "row_no", "fields", "extra"]
    for pdf in batches:
        for path, name in zip(pdf["archive"], pdf["member"]):
            with open_stream(path) as raw, zipfile.ZipFile(raw) as archive:
                with archive.open(name) as stream:
                    encoding, sep = member_layout(stream)
                if name.lower().endswith(".tsv"):
                    sep = "\t"
                csv.field_size_limit(max(csv.field_size_limit(), archive.getinfo(name).file_size))  # a field may be all of its member
                with archive.open(name) as stream:
                    rows = csv.reader(io.TextIOWrapper(stream, encoding=encoding, newline=""), delimiter=sep)
                    header, out, n, chars = None, [], 0, 0
                    for row in rows:
                        if not row:
                            continue
                        if header is None:
                            header = [h.strip() for h in row]
                            continue
                        out.append((path, name, n, dict(zip(header, row)), len(row) - len(header)))
                        n += 1
                        chars += sum(map(len, row))
                        if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                            yield pd.DataFrame(out, columns=columns)
                            out, chars = [], 0
                    if out:
                        yield pd.DataFrame(out, columns=columns)


def read_members(members: DataFrame, columns: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """(archive, member, row_no, fields, extra): every record of every member in ``members``.

    ``fields`` maps header names to texts; quoted delimiters and line breaks are part of a field.  A
    record with fewer or more fields than the header is kept: ``extra`` is the difference, missing
    fields are absent and surplus ones are not in the map.  With ``columns`` these are projected
    out of the map under normalised names.
    """
    tasks = tasks or tasks_for(members.sparkSession, members.count())
    rows = members.select("archive", "member").repartition(tasks, "archive", "member").mapInPandas(_records, RECORDS)
    if columns is None:
        return rows
    return rows.select("archive", "member", "row_no", *[F.col("fields")[c].alias(n) for c, n in zip(columns, unique_columns(columns))])


def write_zip(rows: DataFrame, folder: str, header: list[str], sep: str = ",", part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write rows (archive, member, order, line) sorted by member and order to ZIP files in a shared folder; returns
    (file, members).  ``line`` is an array of texts.

    An archive of more than ``part_rows`` rows or ``part_bytes`` bytes is dealt by a hash of ``order`` to several files
    (``name.part00000.zip``), so a hot one is written by many tasks.  A task sorts outside Python and writes row by row; a
    repeated attempt replaces its files.
    """
    import uuid
    from itertools import groupby

    size = F.octet_length(F.concat_ws("", "line"))
    sizes = rows.groupBy("archive").agg(F.ceil(F.greatest(F.count(F.lit(1)) / part_rows, F.sum(size) / part_bytes)).alias("_parts"))
    sizes = sizes.withColumnRenamed("archive", "_archive").checkpoint(eager=True)
    dealt = rows.join(small_side(sizes), F.col("archive").eqNullSafe(F.col("_archive")))
    part = F.format_string(".part%05d.zip", F.pmod(F.xxhash64("order"), F.col("_parts")))
    file = F.when(F.col("_parts") > 1, F.concat(F.regexp_replace("archive", r"\.zip$", ""), part)).otherwise(F.col("archive"))
    dealt = dealt.select(file.alias("file"), "member", "order", "line")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        base = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        filesystem, inner = pafs.FileSystem.from_uri(base)
        filesystem.create_dir(inner, recursive=True)
        records = (r for pdf in batches for r in zip(pdf["file"], pdf["member"], pdf["line"]))
        for name, of_file in groupby(records, key=lambda r: r[0]):
            temporary, members = f"{inner}/_{uuid.uuid4().hex}", 0
            with filesystem.open_output_stream(temporary) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for member, of_member in groupby(of_file, key=lambda r: r[1]):
                    with archive.open(zipfile.ZipInfo(member), "w", force_zip64=True) as raw, io.TextIOWrapper(raw, "utf-8", newline="") as text:
                        writer = csv.writer(text, delimiter=sep)
                        writer.writerow(header)
                        writer.writerows(line for _, _, line in of_member)
                    members += 1
            filesystem.move(temporary, f"{inner}/{name}")
            yield pd.DataFrame({"file": [name], "members": [members]})

    return dealt.repartition("file").sortWithinPartitions("file", "member", "order").select("file", "member", "line").mapInPandas(write, "file string, members long")


def archive_name(path: Column) -> Column:
    """The name that an archive had in ``write_zip``, from the path of one of its files."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.part\d{5,}\.zip$", ".zip")
