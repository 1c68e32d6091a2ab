"""Driver contract and streaming = batch."""

import __spark_entry__ as entry
from flowlens.plans import q_stream
from flowlens.plans.q_stream import run_event_stream
from flowlens.plans.registry import table
from flowlens.operators.windows import window_features
from flowlens.plans.q_windows import event_packets

SF = "/root/testdata/sf0.01"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "packet_count" in df.columns


def test_registry_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_stream_equals_batch(spark):
    # a short watermark: slices are folded into summaries while their windows are still open
    stream = run_event_stream(spark, SF, width=3600, files=4, watermark="10 minutes")
    batch = window_features(event_packets(spark, SF), widths=(3600,), anchor="epoch")
    cols = sorted(batch.columns)
    assert sorted(stream.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def test_stream_ranges_are_written_by_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(q_stream, "table", lambda *a: table(*a).repartition(3))
    monkeypatch.setattr(q_stream, "scratch_path", lambda spark, name: str(tmp_path))
    stream = run_event_stream(spark, SF, width=3600, files=3, watermark="10 minutes")
    batch = window_features(event_packets(spark, SF), widths=(3600,), anchor="epoch")
    cols = sorted(batch.columns)
    assert sorted(stream.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    assert sum(f.stat().st_size > 2_000 for f in (tmp_path / "in").glob("part-*.parquet")) == 9


def test_inner_gaps_of_distinct_times(spark):
    from pyspark.sql import functions as F

    from flowlens.streaming.windows import inner_gaps

    rows = [([5, 1, 9], 3), ([5, 1, 9], 4), ([7], 1), ([7], 5), ([3, 2], 2)]
    df = spark.createDataFrame(rows, "t array<long>, n long")
    got = [tuple(r) for r in df.select("t", "n", *inner_gaps(F.col("t"), F.col("n"))).collect()]
    assert [(r[2], r[3], int(r[4])) for r in got] == [(4, 4, 32), (0, 4, 32), (None, None, 0), (0, 0, 0), (1, 1, 1)]


def test_a_busy_second_is_spread_over_tasks(spark):
    """All rows in one second: many slices, and the same windows as from one slice."""
    from pyspark.sql import functions as F

    from flowlens.operators import windows

    packets = spark.range(4000).select((F.col("id") * 7919 % 1_000_000).alias("ts_us"), (F.col("id") % 50).alias("len_u"), (F.col("id") % 3 == 0).cast("int").alias("binary_label"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("multiclass_label"))
    width = windows.slice_width_us([3600 * windows.US])
    assert packets.select(windows.floor_div(F.col("ts_us"), width)).distinct().count() == 16
    many = window_features(packets, widths=(3600,), anchor="epoch").collect()
    assert windows.slice_width_us([3600 * windows.US], 1) == windows.US
    assert len(many) == 1 and many[0]["packet_count"] == 4000
    times = sorted(r["ts_us"] for r in packets.collect())
    gaps = [b - a for a, b in zip(times, times[1:])]
    assert many[0]["iat_min"] == min(gaps) / 1e6 and many[0]["iat_max"] == max(gaps) / 1e6
