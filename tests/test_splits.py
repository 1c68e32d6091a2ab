"""Split sizes (committed result goldens), disjointness, stratification, group and time rules."""

from pyspark.sql import functions as F

from flowlens.operators.splits import (
    class_cap_sample, first_n_budget, group_split, random_stratified_split, split_validity, stratified_cuts,
    time_block_split,
)


def test_golden_stratified_sizes(spark):
    for n, expect in ((222_567, (155_796, 33_385, 33_386)), (259_379, (181_565, 38_907, 38_907)),
                      (16_915, (11_840, 2_537, 2_538)), (6_849, (4_794, 1_027, 1_028)), (5_081, (3_556, 762, 763))):
        df = spark.range(n).withColumn("y", (F.col("id") * 7 % 10 < 3).cast("int"))
        c = stratified_cuts(df, "y").agg(F.sum("train_c"), F.sum("val_c"), F.sum("n_c")).first()
        assert (c[0], c[1], c[2] - c[0] - c[1]) == expect


def test_golden_time_block_sizes(spark):
    df = spark.range(259_379).withColumn("t", F.col("id") * 3 % 1000)
    sizes = {r["split"]: r["count"] for r in time_block_split(df, ["t", "id"]).groupBy("split").count().collect()}
    assert (sizes["train"], sizes["val"], sizes["test"]) == (181_565, 38_906, 38_908)


def test_time_block_is_ordered(spark):
    df = spark.range(5000).withColumn("t", (F.col("id") * 37) % 101)
    out = time_block_split(df, ["t", "id"]).groupBy("split").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    r = {x["split"]: x for x in out.collect()}
    assert r["train"]["hi"] <= r["val"]["lo"] and r["val"]["hi"] <= r["test"]["lo"]


def test_stratified_disjoint_complete_and_stratified(spark):
    df = spark.range(3000).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    out = random_stratified_split(df, "y", ["id"], seed=42)
    assert out.count() == 3000 and out.select("id").distinct().count() == 3000
    share = out.groupBy("split").agg(F.avg("y").alias("p")).collect()
    base = 3000 // 7 / 3000
    for r in share:
        assert abs(r["p"] - base) < 0.01


def test_group_split_never_shares_groups(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") < 50, None).otherwise(F.col("id") % 37))
    out = group_split(df, "g", seed=1)
    assert out.groupBy("g").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    assert out.count() == 2000


def test_validity_single_class(spark):
    df = spark.range(100).withColumn("y", F.lit(1)).withColumn("split", F.when(F.col("id") < 70, "train").otherwise("test"))
    assert split_validity(df, "y").first()["status"] == "invalid_split_train_single_class"


def test_class_cap_and_budget(spark):
    df = spark.range(1000).withColumn("c", (F.col("id") % 3).cast("string"))
    capped = class_cap_sample(df, "c", ["id"], max_per_class=100, sample_size=250)
    assert capped.count() == 250
    assert max(r["count"] for r in capped.groupBy("c").count().collect()) <= 100
    firsts = first_n_budget(df, "c", ["id"], cap=5, budget=12).collect()
    assert [r["id"] for r in firsts] == list(range(12))


def test_class_table_on_the_driver_gives_the_same_cuts(spark, monkeypatch):
    from flowlens.operators import splits

    counts = spark.createDataFrame([("b", 11), ("a", 11), (None, 7), ("c", 1), ("é", 300)], "label string, n_c long")
    few = sorted(map(str, splits.stratified_cuts_from_counts(counts, "label").collect()))
    monkeypatch.setattr(splits, "DRIVER_CLASSES", 2)
    assert sorted(map(str, splits.stratified_cuts_from_counts(counts, "label").collect())) == few
