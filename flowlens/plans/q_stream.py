"""Streaming window query (T1): events replayed as a file stream, checked against the batch SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.windows import prepare_packets
from flowlens.plans.q_windows import EVENT_LABEL_MAP, flow_window_sql
from flowlens.plans.registry import query, table
from flowlens.session import scratch_path
from flowlens.streaming.windows import stream_slices, windows_of_updates

STREAM_WIDTH = 3600
STREAM_FILES = 8


def run_event_stream(spark: SparkSession, sf_dir: str, width: int = STREAM_WIDTH, files: int = STREAM_FILES,
                     watermark: str = "2 hours") -> DataFrame:
    """Write events as ``files`` time ranges, each by many tasks, replay one range per run of the stream
    (``trigger(availableNow=True)``, same checkpoint), append every batch's slice updates and return the windows that the last ones make."""
    root = scratch_path(spark, f"stream/{uuid.uuid4().hex}")
    src_dir, out_dir, ckpt = (os.path.join(root, p) for p in ("in", "out", "checkpoint"))
    events = table(spark, sf_dir, "events")
    # a run takes all files of the range just written: files inside a range have no order, and the watermark must not pass
    # the times of those still unread
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.select(us.alias("u")).approxQuantile("u", [i / files for i in range(1, files)], 1e-4)
    edges = [None, *bounds, None]
    events.limit(0).write.parquet(src_dir)  # the stream needs the folder
    stream = spark.readStream.schema(events.schema).parquet(src_dir)
    packets = prepare_packets(stream, ts="ts", length="value", label="event_type", label_map=EVENT_LABEL_MAP,
                              default_binary=0)
    updates = stream_slices(packets, width, watermark=watermark)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_dir)

    for lo, hi in zip(edges[:-1], edges[1:]):
        part = events
        if lo is not None:
            part = part.where(us >= F.lit(int(lo)))
        if hi is not None:
            part = part.where(us < F.lit(int(hi)))
        part.write.mode("append").parquet(src_dir)
        q = updates.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt) \
            .trigger(availableNow=True).start()
        q.awaitTermination()
    return windows_of_updates(spark.read.parquet(out_dir), width)


@query("stream_windows", flow_window_sql([STREAM_WIDTH], anchor="epoch"))
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming one-hour windows (epoch anchored, watermark 2 h); equals the batch windows."""
    return run_event_stream(spark, sf_dir)
