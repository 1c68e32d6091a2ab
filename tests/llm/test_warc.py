"""Archives: seek table, frames, index, revisits, round trip."""

import hashlib
import io

import zstandard

from flowlens.llm.warc import FOOTER, SEEKABLE, bundle_frames, find_records, read_bundles, seek_table, write_bundles


def pages():
    big = "x<p>é</p>" * 30
    rows = [(5, "http://a/5", big), (3, "http://a/3", big), (9, None, big), (4, "u", "short"), (2, "u", "short"), (1, "u", None), (8, "u", ""), (None, "n", "null id " * 40), (7, "u\r\nx", "y" * 100), (6, "u", "y" * 100), (10, "u", "z" * 3_000_000)]
    return rows + [(100 + k, "u", f"page {k} " * 50) for k in range(300)]


def written(spark, tmp_path):
    docs = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    return folder, write_bundles(docs, folder, frame_bytes=10_000, bundle_bytes=3_000)


def test_round_trip(spark, tmp_path):
    folder, index = written(spark, tmp_path)
    got = {r["record_id"]: r for r in read_bundles(index, folder, payloads=True).collect()}
    assert len(got) == len(pages())
    refers = {5: "3", 9: "3", 7: "6"}
    for i, _, html in pages():
        raw, r = (html or "").encode(), got[None if i is None else str(i)]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", refers[i]) if i in refers else ("response", None))
        assert r["payload"] is None if i in refers else bytes(r["payload"]) == raw


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, tmp_path):
    folder, index = written(spark, tmp_path)
    files = sorted((tmp_path / "warc").glob("*.warc.zst"))
    assert len(files) > 3 and not list((tmp_path / "warc").glob("_*"))
    for f in files:
        raw = f.read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        parts = [zstandard.ZstdDecompressor().decompress(raw[a : a + n]) for a, n in seek_table(io.BytesIO(raw), len(raw))]
        assert b"".join(parts) == whole and whole.startswith(b"WARC/1.1\r\n")
        assert FOOTER.unpack(raw[-9:])[2] == SEEKABLE
    assert bundle_frames(index, folder).count() > len(files)


def test_records_are_found_by_identifier(spark, tmp_path):
    folder, index = written(spark, tmp_path)
    ids = spark.createDataFrame([("10",), ("104",), ("9",), ("none",)], "record_id string")
    got = {r["record_id"]: r for r in find_records(index, folder, ids).collect()}
    assert set(got) == {"10", "104", "9"}
    assert bytes(got["104"]["payload"]) == ("page 4 " * 50).encode() and got["9"]["refers_to"] == "3"
