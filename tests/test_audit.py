"""Single-feature audit scores on separable and uninformative features."""

from pyspark.sql import functions as F

from flowlens.operators.audit import single_feature_scores


def test_separable_vs_constant(spark):
    df = spark.range(400).select(
        "id", (F.col("id") % 2).cast("int").alias("binary_label"),
        ((F.col("id") % 2) * 10 + (F.col("id") % 5)).cast("double").alias("good"),
        F.lit(1.0).alias("flat"),
        F.when(F.col("id") % 2 == 1, "x").otherwise("y").alias("cat"))
    scores = {r["feature"]: r["single_feature_macro_f1"]
              for r in single_feature_scores(df, ["good", "flat", "cat"], "t", id_cols=["id"]).collect()}
    assert scores["good"] == 1.0 and scores["cat"] == 1.0
    assert scores["flat"] < 0.7


def test_single_class_gives_null(spark):
    df = spark.range(50).select("id", F.lit(1).alias("binary_label"), F.col("id").cast("double").alias("f"))
    assert single_feature_scores(df, ["f"], "t", id_cols=["id"]).first()["single_feature_macro_f1"] is None


def test_permutation_importance(spark):
    from flowlens.operators.experiments import permutation_importance

    df = spark.range(600).select(
        "id", (F.col("id") % 2).cast("int").alias("binary_label"),
        ((F.col("id") % 2) * 10 + (F.col("id") % 5)).cast("double").alias("good"),
        F.lit(1.0).alias("flat"))
    imp = {r["feature"]: r["importance"]
           for r in permutation_importance(df, ["good", "flat"], "t", "strict", model="Random Forest",
                                           id_cols=["id"]).collect()}
    assert imp["good"] > 0.3 and imp["flat"] == 0.0
