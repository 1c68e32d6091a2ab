"""Window features against a brute-force pandas computation on edge-case packets."""

import math

import pandas as pd
from pyspark.sql import functions as F

from flowlens.operators.windows import prepare_packets, window_features

ROWS = [  # timestamp (s), length, label
    (100.0, 60.0, "legitimate"),   # window 0: single packet
    (105.0, 70.0, "dos"), (105.0, 80.0, "legitimate"),  # window 1 (w=5): equal timestamps, tie majority
    (111.0, 10.0, "dos"), (112.5, 30.0, "dos"), (114.0, 20.0, "legitimate"),  # window 2: mixed
    (130.25, 0.0, "flood"), (131.0, 0.0, "flood"),  # zero bytes -> burstiness 0
    (None, 5.0, "dos"), (140.0, None, "dos"), (141.0, 5.0, None), (142.0, 5.0, "unknown"),  # dropped
]


def brute(rows, w):
    df = pd.DataFrame(rows, columns=["timestamp", "tcp_len", "label"]).dropna()
    df = df[df["label"].str.strip().str.lower() != "unknown"]
    t0 = df["timestamp"].min()
    df = df.assign(wid=((df["timestamp"] - t0) // w).astype(int)).sort_values(["timestamp"], kind="stable")
    out = {}
    for wid, g in df.groupby("wid"):
        ts, ln = g["timestamp"].to_numpy(), g["tcp_len"].to_numpy()
        iat = ts[1:] - ts[:-1]
        dur = ts.max() - ts.min()
        counts = g.groupby("label").agg(n=("label", "size"), first=("timestamp", "min")).reset_index()
        maj = counts.sort_values(["n", "first", "label"], ascending=[False, True, True]).iloc[0]
        mean, std = ln.mean(), ln.std()
        out[wid] = dict(packet_count=len(g), byte_sum=ln.sum(), byte_mean=mean, byte_std=std, duration=dur,
                        packets_per_second=len(g) / dur if dur > 0 else len(g) / w,
                        iat_mean=iat.mean() if len(iat) else 0.0, iat_std=iat.std() if len(iat) else 0.0,
                        iat_min=iat.min() if len(iat) else 0.0, iat_max=iat.max() if len(iat) else 0.0,
                        burstiness=std / mean if mean > 0 else 0.0, multiclass_label=maj["label"],
                        mixed_label_ratio=1 - maj["n"] / len(g),
                        binary_label=int((g["label"] != "legitimate").any()))
    return out


def test_windows_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, "timestamp double, tcp_len double, label string")
    for w in (5, 10):
        got = {r["window_id"]: r.asDict() for r in window_features(prepare_packets(df), widths=(w,)).collect()}
        want = brute(ROWS, w)
        assert set(got) == set(want)
        for wid, exp in want.items():
            for k, v in exp.items():
                g = got[wid][k]
                if isinstance(v, str):
                    assert g == v, (w, wid, k)
                else:
                    assert math.isclose(g, float(v), rel_tol=1e-9, abs_tol=1e-9), (w, wid, k, g, v)


def test_sweep_equals_single_widths(spark):
    df = spark.createDataFrame(ROWS, "timestamp double, tcp_len double, label string")
    p = prepare_packets(df)
    sweep = window_features(p, widths=(5, 10)).orderBy("window_seconds", "window_id").collect()
    single = (window_features(p, widths=(5,)).unionByName(window_features(p, widths=(10,)))
              .orderBy("window_seconds", "window_id").collect())
    assert sweep == single


def test_keyed_windows_and_epoch_anchor(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0, "a"), (1, 2.0, 10.0, "a"), (2, 1.5, 5.0, "b")],
                               "k int, timestamp double, tcp_len double, label string")
    out = window_features(prepare_packets(df, keys=("k",)), widths=(10,), keys=("k",), anchor="epoch")
    rows = {r["k"]: r for r in out.collect()}
    assert rows[1]["packet_count"] == 2 and rows[2]["packet_count"] == 1
    assert rows[1]["window_id"] == 0 and rows[1]["iat_max"] == 1.0
    assert out.where(F.col("binary_label") == 1).count() == 2
