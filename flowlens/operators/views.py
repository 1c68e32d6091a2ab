"""Observability views under two policies.

Views are decided on a *columns table* ``(dataset, ordinal, column, kind,
is_mqtt)`` - one row per column of each source table - with the rule
expressions of :mod:`flowlens.functions.rules`.  The data itself is only
touched by :func:`project_view`, a column-pruned ``select`` that Catalyst
pushes into the scan.

Policies: ``audited_metadata_main`` drops hard-leakage, analysis-parameter
and label columns; ``conservative_anti_leakage`` additionally drops every
feature whose single-feature score exceeds 0.90 (a left-anti join against
the audit report, keyed by dataset or the wildcard ``*``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.rules import classify_columns
from flowlens.vocab import COMMON_CROSS_FEATURES, POLICY_CONSERVATIVE, POLICY_MAIN, VIEW_ROLES

LABELS = ("binary_label", "multiclass_label")
MAIN_NOTE = "Main policy: hard leakage and sensitive content removed; legitimate encrypted-flow metadata retained."
CONSERVATIVE_NOTE = "Sensitivity policy: hard leakage removed plus single-feature Macro F1 > 0.90 metadata removed."


@dataclass
class Source:
    """A registered source table (dataset name, kind, MQTT or not, the DataFrame)."""

    dataset: str
    kind: str  # packet | flow | flow_window
    is_mqtt: bool
    df: DataFrame


def source_catalog(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The columns table of all sources (schema sized)."""
    rows = [(s.dataset, i, c, s.kind, s.is_mqtt) for s in sources for i, c in enumerate(s.df.columns)]
    return spark.createDataFrame(rows, "dataset string, ordinal int, column string, kind string, is_mqtt boolean")


def base_features(catalog: DataFrame) -> DataFrame:
    """Classified columns with ``is_feature`` = not hard, not analysis parameter, not a label name."""
    cls = classify_columns(catalog)
    return cls.withColumn("is_feature", ~F.col("is_hard") & ~F.col("is_analysis") & ~F.col("is_label"))


def _role_rows(features: DataFrame, policy: str) -> DataFrame:
    """Long (dataset, policy, view_role, ordinal, feature) for the three roles."""
    f = features.where("is_feature")
    full = f.withColumn("view_role", F.lit("full"))
    broker = f.where(F.col("is_mqtt") & ((F.col("kind") == "flow_window") | F.col("broker_token"))).withColumn(
        "view_role", F.lit("broker"))
    strict = f.where(F.col("strict_token")).withColumn("view_role", F.lit("strict"))
    return (full.unionByName(broker).unionByName(strict)
            .select("dataset", F.lit(policy).alias("policy"), "view_role", "ordinal", F.col("column").alias("feature")))


def conservative_exclusions(report: DataFrame, threshold: float = 0.90) -> DataFrame:
    """(dataset, feature) with score > threshold; dataset may be '*' (all datasets)."""
    return (report.where(F.col("single_feature_macro_f1").isNotNull() & (F.col("single_feature_macro_f1") > threshold))
            .select(F.coalesce(F.nullif(F.trim(F.col("dataset")), F.lit("")), F.lit("*")).alias("ex_dataset"),
                    F.trim(F.col("feature")).alias("ex_feature"))
            .where(F.col("ex_feature") != "").distinct())


def view_membership(catalog: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Both policies: (dataset, policy, view_role, ordinal, feature)."""
    feats = base_features(catalog)
    main = _role_rows(feats, POLICY_MAIN)
    if exclusions is None:
        cons_feats = feats
    else:
        # Anti join on (dataset in (d, '*'), feature)
        hit = (feats.alias("f").join(exclusions.alias("x"),
                                     (F.col("f.column") == F.col("x.ex_feature"))
                                     & ((F.col("x.ex_dataset") == F.col("f.dataset")) | (F.col("x.ex_dataset") == "*")),
                                     "left_semi"))
        cons_feats = feats.join(hit.select("dataset", "ordinal"), ["dataset", "ordinal"], "left_anti")
    cons = _role_rows(cons_feats, POLICY_CONSERVATIVE)
    return main.unionByName(cons)


def _ordered_names(values: Column) -> Column:
    """Names of an array<struct<ordinal, name>> in ordinal order, joined by ';'."""
    return F.array_join(F.transform(F.array_sort(values), lambda s: s["name"]), ";")


def view_descriptors(catalog: DataFrame, membership: DataFrame) -> DataFrame:
    """One row per (dataset, policy, role): status, counts, included/excluded feature lists."""
    feats = base_features(catalog)
    datasets = catalog.select("dataset", "kind", "is_mqtt").distinct()
    hard = feats.where("is_hard").groupBy("dataset").agg(
        F.array_join(F.array_sort(F.collect_list("column")), ";").alias("excluded_hard_leakage_features"))
    analysis = feats.where("is_analysis").groupBy("dataset").agg(
        F.array_join(F.array_sort(F.collect_list("column")), ";").alias("excluded_analysis_parameter_features"))
    grid = _grid(datasets)
    inc = membership.groupBy("dataset", "policy", "view_role").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.collect_list(F.struct(F.col("ordinal"), F.col("feature").alias("name"))).alias("_inc"))
    main = membership.where(F.col("policy") == POLICY_MAIN).select("dataset", "view_role", F.col("feature").alias("mf"))
    cons = membership.where(F.col("policy") == POLICY_CONSERVATIVE).select("dataset", "view_role", F.col("feature").alias("mf"))
    extra = main.join(cons, ["dataset", "view_role", "mf"], "left_anti").groupBy("dataset", "view_role").agg(
        F.array_join(F.array_sort(F.collect_list("mf")), ";").alias("_extra"))
    out = (grid.join(inc, ["dataset", "policy", "view_role"], "left")
           .join(hard, "dataset", "left").join(analysis, "dataset", "left")
           .join(extra, ["dataset", "view_role"], "left"))
    n = F.coalesce(F.col("n_features"), F.lit(0)).cast("int")
    status = (F.when((F.col("view_role") == "broker") & ~F.col("is_mqtt"), F.lit("not_applicable"))
              .when(n < 5, F.lit("weak_view")).otherwise(F.lit("ok")))
    return out.select(
        "dataset", "policy", "view_role", F.concat_ws("_", "view_role", "policy").alias("view"), status.alias("status"),
        n.alias("n_features"),
        F.coalesce(_ordered_names(F.col("_inc")), F.lit("")).alias("included_features"),
        F.coalesce(F.col("excluded_hard_leakage_features"), F.lit("")).alias("excluded_hard_leakage_features"),
        F.coalesce(F.col("excluded_analysis_parameter_features"), F.lit("")).alias("excluded_analysis_parameter_features"),
        F.when(F.col("policy") == POLICY_CONSERVATIVE, F.coalesce(F.col("_extra"), F.lit(""))).otherwise(F.lit(""))
        .alias("excluded_conservative_only_features"),
        F.when(F.col("policy") == POLICY_MAIN, F.lit(MAIN_NOTE)).otherwise(F.lit(CONSERVATIVE_NOTE)).alias("notes"))


def _grid(datasets: DataFrame) -> DataFrame:
    """Every dataset x policy x role (built with explode, no cross join)."""
    combos = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("view_role"))
                                 for p in (POLICY_MAIN, POLICY_CONSERVATIVE) for r in VIEW_ROLES]))
    return datasets.select("*", combos.alias("c")).select("dataset", "kind", "is_mqtt", "c.policy", "c.view_role")


def view_features(membership: DataFrame, dataset: str, policy: str, role: str) -> list[str]:
    """Feature names of one view in column order (schema sized; collected to plan a projection)."""
    rows = (membership.where((F.col("dataset") == dataset) & (F.col("policy") == policy) & (F.col("view_role") == role))
            .orderBy("ordinal").select("feature").collect())
    return [r["feature"] for r in rows]


def project_view(df: DataFrame, features: list[str]) -> DataFrame:
    """K4: label columns first, then the view's features (a pruned projection)."""
    labels = [c for c in LABELS if c in df.columns]
    return df.select(*labels, *features)


def common_features(*feature_lists: list[str]) -> list[str]:
    """Features present in every list, in the canonical common-feature order."""
    return [f for f in COMMON_CROSS_FEATURES if all(f in fl for fl in feature_lists)]
