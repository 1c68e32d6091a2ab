"""Zeek parsing, delimiter sniffing, discovery, ZIP members, sizes and links on small fixtures."""

import io
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from flowlens.sources.archives import archive_name, read_members, write_zip, zip_members
from flowlens.sources.files import discover_files, file_facts, read_delimited, select_variant, sniff_delimiters
from flowlens.sources.pages import listing_rows, size_to_bytes
from flowlens.sources.zeek import parse_zeek, zeek_flows

HEADER = "#fields\tts\tduration\torig_bytes\tresp_bytes\torig_pkts\tresp_pkts\torig_ip_bytes\tresp_ip_bytes\t" \
         "missed_bytes\tproto\tservice\tconn_state\thistory\tlabel\tdetailed-label"


def test_zeek_edge_lines(spark):
    lines = ["#separator \\x09", HEADER,
             "1\t2.0\t10\t-\t1\t2\t50\t(empty)\t0\ttcp\t-\tSF\tShAdDaFf^\tBenign\t-",
             "2\t-\t5\t5\t1\t1\t1\t1\t0\tudp\tdns\tS0\t-\tMalicious\tDDoS",
             "3\t0\t5\t5\t1\t1\t1\t1\t0\tudp\tdns\tS0\tDd\tMalicious\t-",
             "4\t1\t1\t1",  # wrong arity
             "", "#close"]
    df = spark.createDataFrame([("conn.log.labeled", i, v) for i, v in enumerate(lines)],
                               "source_file string, line_no long, value string")
    rows = {r["multiclass_label"]: r for r in zeek_flows(parse_zeek(df), max_per_class=None).collect()}
    assert set(rows) == {"benign", "DDoS", "malicious"}
    b = rows["benign"]
    assert b["binary_label"] == 0 and b["resp_bytes"] is None and b["resp_ip_bytes"] is None and b["service"] is None
    assert b["history_len"] == 9 and b["history_count_caret"] == 1 and b["history_count_d_orig"] == 1 and b["history_count_d_resp"] == 1
    assert b["total_bytes"] == 10.0 and b["bytes_per_second"] == 5.0
    assert rows["DDoS"]["history_len"] == 1 and rows["DDoS"]["duration"] is None and rows["DDoS"]["bytes_per_second"] == 0.0
    assert rows["malicious"]["packets_per_second"] == 0.0


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_discovery_and_sniffing(spark):
    root = tempfile.mkdtemp(prefix="flowlens-src-")
    _write(f"{root}/a/x_biflow.csv", "a;b;c\n1;2;3\n4;5;6\n")
    _write(f"{root}/a/y_uniflow.tsv", "a\tb\n1\t2\n")
    _write(f"{root}/b/z.txt", "a|b\n7|8\n")
    _write(f"{root}/b/README.txt", "notes, more notes\n")
    _write(f"{root}/b/train_SMOTE.csv", "a,b\n1,2\n")
    _write(f"{root}/b/ignore.json", "{}")
    paths = [r["path"] for r in discover_files(spark, root).collect()]
    names = sorted(p.rsplit("/", 1)[-1] for p in paths)
    assert names == ["x_biflow.csv", "y_uniflow.tsv", "z.txt"]
    seps = {p.rsplit("/", 1)[-1]: s for p, s in sniff_delimiters(spark, paths).items()}
    assert seps == {"x_biflow.csv": ";", "y_uniflow.tsv": "\t", "z.txt": "|"}
    df = read_delimited(spark, paths, dataset="d")
    assert df.count() == 4 and {"a", "b", "c", "source_file", "dataset_name"} <= set(df.columns)
    chosen, note = select_variant(paths)
    assert note == "selected_biflow_features" and len(chosen) == 1


def test_zip_members(spark):
    root = tempfile.mkdtemp(prefix="flowlens-zip-")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("nested/dir/flows.csv", "a,b\n1,2\n3,4\n")
        zf.writestr("nested/semi.txt", "a;b\n5;6\n")
        zf.writestr("nested/data_smote.csv", "a,b\n9,9\n")
        zf.writestr("other/flows.csv", 'a,b\n"p,q","two\nlines ""quoted"""\n\xe9\n')
        zf.writestr("readme.md", "x")
    with open(f"{root}/arch.zip", "wb") as fh:
        fh.write(buf.getvalue())
    members = zip_members(spark, root)
    assert sorted(r["member"] for r in members.collect()) == ["nested/dir/flows.csv", "nested/semi.txt", "other/flows.csv"]
    wide = read_members(members, ["a", "b"], tasks=3).orderBy("member", "row_no").collect()
    assert [(r["member"], r["a"], r["b"]) for r in wide] == [
        ("nested/dir/flows.csv", "1", "2"), ("nested/dir/flows.csv", "3", "4"), ("nested/semi.txt", "5", "6"),
        ("other/flows.csv", "p,q", 'two\nlines "quoted"'), ("other/flows.csv", "é", None)]


def test_files_of_other_layouts_land_under_their_own_names(spark):
    root = tempfile.mkdtemp(prefix="flowlens-union-")
    for name, raw in (("a.csv", b"x,y\n1,10\n2,20\n"), ("b.csv", b"y,x,z\n30,3,300\n"), ("c.csv", "\ufeffx;t\n4;\"a;b\nc\"\n".encode()),
                      ("d.csv", "x,t\n5,caf\xe9\n".encode("latin1")), ("e.csv", b"x,y\n6\n"), ("f.csv", b"")):
        with open(f"{root}/{name}", "wb") as fh:
            fh.write(raw)
    paths = [r["path"] for r in discover_files(spark, root).collect()]
    facts = {r["path"].rsplit("/", 1)[-1]: r for r in file_facts(spark, paths).collect()}
    assert facts["e.csv"]["bad_lines"] == 1 and facts["d.csv"]["encoding"] == "ISO-8859-1" and facts["c.csv"]["multiline"] and "f.csv" not in facts
    with pytest.warns(UserWarning, match="disagree"):
        rows = read_delimited(spark, paths).collect()
    got = sorted((r["x"], r["y"], r["z"], r["t"]) for r in rows)
    assert got == [(1.0, 10.0, None, None), (2.0, 20.0, None, None), (3.0, 30.0, 300.0, None), (4.0, None, None, "a;b\nc"),
                   (5.0, None, None, "caf\xe9"), (6.0, None, None, None)]


def test_sizes_and_listing(spark):
    df = spark.createDataFrame([("12.5K",), ("3 M",), ("7",), ("1.5P",), ("x",)], "t string")
    got = [r[0] for r in df.select(size_to_bytes(F.col("t"))).collect()]
    assert got == [12800, 3 * 1024 ** 2, 7, 1, None]
    html = ('<table><tr><td><a href="x/conn.log.labeled">log</a></td><td>12K</td></tr>'
            '<tr><td><a href="readme.txt">r</a> 2M</td></tr></table>')
    rows = listing_rows(spark.createDataFrame([(1, html)], "page_id int, html string"), row_tag="tr").collect()
    assert [(r["href"], r["size_bytes"], r["is_candidate"]) for r in rows] == [
        ("x/conn.log.labeled", 12288, True), ("readme.txt", 2 * 1024 ** 2, False)]


def test_sinks_round_trip(spark):
    from flowlens.sources.sinks import write_json, write_report, write_table, write_view

    root = tempfile.mkdtemp(prefix="flowlens-sink-")
    df = spark.createDataFrame([(1, "a", [1, 2], 0, "benign")], "w int, s string, arr array<int>, binary_label int, "
                                                                "multiclass_label string")
    write_table(df, f"{root}/t", partition_by=["w"])
    assert spark.read.parquet(f"{root}/t").count() == 1
    write_report(df, f"{root}/r")
    rep = spark.read.option("header", True).csv(f"{root}/r").first()
    assert rep["arr"] == "[1,2]"
    write_json(df, f"{root}/j")
    assert spark.read.json(f"{root}/j").first()["s"] == "a"
    write_view(df, ["s"], f"{root}/v")
    assert spark.read.parquet(f"{root}/v").columns == ["binary_label", "multiclass_label", "s"]


def test_hot_archives_are_split_and_long_texts_read(spark):
    root = tempfile.mkdtemp(prefix="flowlens-parts-")
    texts = ["x" * 1_000_000, 'a "b",\nc', "", *[f"row {k}" for k in range(300)]]
    rows = [("hot.zip", f"m{k % 2}/part.csv", k, [str(k), t]) for k, t in enumerate(texts)] + [("small.zip", "m/part.csv", 1, ["1", "z"])]
    written = write_zip(spark.createDataFrame(rows, "archive string, member string, order long, line array<string>"), root, ["k", "text"], part_rows=50).collect()
    assert len(written) > 4 and "small.zip" in {r["file"] for r in written} and sorted(os.listdir(root)) == sorted(r["file"] for r in written)
    got = read_members(zip_members(spark, root), tasks=3).select(archive_name(F.col("archive")), "member", F.col("fields")["k"], F.col("fields")["text"], "extra")
    assert sorted(map(tuple, got.collect())) == sorted((a, m, *line, 0) for a, m, _, line in rows)
