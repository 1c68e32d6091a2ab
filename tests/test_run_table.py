"""The run table's parts: counted predictions give the metrics of their rows; one part of a split alone."""

from pyspark.sql import functions as F

from flowlens.operators import metrics, splits
from flowlens.plans import QUERIES


def _rows(df):
    return sorted(map(str, df.collect()))


def test_counted_rows_give_the_same_metrics(spark):
    data = [("a", y, p, s) for y, p, s in [(1, 1, 0.9), (1, 1, 0.9), (0, 1, 0.9), (0, 0, 0.2), (1, 0, 0.2), (0, 0, None), (None, 1, 0.5)]]
    df = spark.createDataFrame(data * 3 + data[:2], "run string, y int, pred int, score double")
    counted = df.groupBy("run", "y", "pred", "score").agg(F.count(F.lit(1)).alias("n"))
    assert _rows(metrics.classification_metrics(df, ["run"])) == _rows(metrics.classification_metrics(counted, ["run"], times="n"))
    assert _rows(metrics.ranking_metrics(df, ["run"])) == _rows(metrics.ranking_metrics(counted, ["run"], times="n"))


def test_one_part_of_a_split(spark):
    df = spark.createDataFrame([(i, i // 7 if i % 11 else None, i % 3 if i % 13 else None) for i in range(700)], "id long, t int, y int")
    for cut in (lambda **named: splits.random_stratified_split(df, "y", ["id"], **named), lambda **named: splits.time_block_split(df, ["t", "id"], **named)):
        whole = cut()
        for part in splits.SPLITS:
            assert _rows(cut(only=part)) == _rows(whole.where(F.col("split") == part))


def test_run_table_stores_counts(spark, tmp_path, monkeypatch):
    """What is stored of the test rows doesn't grow when every row comes four times."""
    import datetime

    day = datetime.date(1995, 1, 1)
    rows = [(i, 1, i % 5, i % 3, day + datetime.timedelta(i % 50), (i % 2) / 20, float(i % 4), (i % 2) / 50, "RA"[i % 2]) for i in range(2000)]
    schema = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_discount double, "
              "l_quantity double, l_tax double, l_returnflag string")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    stored, keep = [], type(spark.range(1)).checkpoint

    def checkpoint(df, eager=True):
        kept = keep(df, eager)
        stored.append((set(df.columns), kept))
        return kept

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", checkpoint)
    got = QUERIES["run_metrics"](spark, str(tmp_path)).collect()
    assert len(got) == 18 and all(r["n_test"] == 300 for r in got)
    tests = [d.count() for c, d in stored if {"l_discount", "l_quantity", "l_tax"} <= c]
    assert tests and max(tests) < 300
