"""Single-feature leakage audit.

For every (dataset, feature) at once:

1. balanced sample: at most ``max_per_class`` rows per class in md5 order
   (bucketed rank cut - a big class is never sorted in one task);
2. stratified 70/30 train/test split of the sample (md5 order);
3. the sample becomes one histogram ``(feature, value, split, class) -> n``, summed map-side;
4. encoding of a feature's values: numeric when >= 90 % of the rows parse (inf -> null, nulls
   filled with the median, else 0), otherwise sorted category codes with null as ``<NA>``;
5. a class-balanced CART of depth 3 (gini, ``min_leaf = max(10, 0.002 n)``): the prefix sums of the
   class counts over the sorted values answer every node of every level by lookup, as a node is a range of
   values; test counts fall into the leaves by lookup, too;
6. macro F1 per feature from the confusion counts.

The sample bounds a feature's histogram (classes x ``max_per_class`` values at most), so one group holds
one feature whatever the table's size; features run side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.numeric import NUMBER_PATTERN
from flowlens.functions.rules import audit_note_expr, feature_class_expr, hard_reasons_expr
from flowlens.functions.names import has_any_expr, norm_expr
from flowlens.operators.metrics import confusion_metrics
from flowlens.operators.splits import class_cap_sample, random_stratified_split
from flowlens.session import checkpoint_dir
from flowlens.vocab import DISCRIMINATIVE_CLASSES, DISCRIMINATIVE_SCORE, LEGITIMATE_METADATA_TOKENS, PROTOCOL_METADATA_TOKENS

INF = float("inf")


def parse_number(df: DataFrame, column: str) -> Column:
    """Numeric parse that keeps +-inf (a parsed value) and maps NaN/bad text to null."""
    dtype = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        v = c.cast("double")
    else:
        text = F.lower(F.trim(c.cast("string")))
        v = F.when(text.rlike(NUMBER_PATTERN), F.regexp_replace(text, "_", "").try_cast("double"))
    return F.when(~F.isnan(v), v)


def audit_histogram(df: DataFrame, features: list[str], label: str, dataset: str) -> DataFrame:
    """(dataset, feature, num, txt, y, split, n): rows by value; txt only counts where a value isn't a number."""
    entries = []
    for f in features:
        num = parse_number(df, f)
        entries.append(F.struct(F.lit(f).alias("feature"), num.alias("num"), F.col(f).cast("string").alias("txt")))
    long = df.select(F.col(label).cast("int").alias("y"), "split", F.explode(F.array(*entries)).alias("v"))
    return long.groupBy(F.lit(dataset).alias("dataset"), "v.feature", "v.num", "v.txt", "y", "split").agg(F.count(F.lit(1)).alias("n"))


def encoded(num: np.ndarray, txt: np.ndarray, n: np.ndarray) -> np.ndarray:
    """the value that a tree sees for each entry of a histogram."""
    parsed = ~np.isnan(num)
    if n[parsed].sum() >= 0.9 * n.sum():
        finite = parsed & (np.abs(num) != INF)
        order = np.argsort(num[finite], kind="stable")
        values, upto = num[finite][order], np.cumsum(n[finite][order])
        middle = 0.0
        if len(values):
            low, high = (values[np.searchsorted(upto, k, side="right")] for k in ((upto[-1] - 1) // 2, upto[-1] // 2))
            middle = 0.5 * low + 0.5 * high
        return np.where(finite, num, middle)
    texts = [b"<NA>" if t is None else t.encode() for t in txt]
    code = {t: k for k, t in enumerate(sorted(set(texts)))}
    return np.array([float(code[t]) for t in texts])


def _gini_mass(w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """w * gini = w - (w0^2 + w1^2) / w  (0 for an empty side)."""
    w = w0 + w1
    return np.where(w > 0, w - (w0 * w0 + w1 * w1) / np.where(w > 0, w, 1.0), 0.0)


def leaf_ranges(n0: np.ndarray, n1: np.ndarray, max_depth: int = 3, min_leaf_share: float = 0.002, min_leaf_floor: int = 10) -> list[tuple[int, int, int]]:
    """(first, end, prediction) of the leaves of a balanced CART over the class counts of sorted values.

    A node is a range; its candidate cuts are scored by differences of prefix sums.  Of equal cuts the one at
    the smallest value counts.
    """
    c0, c1 = (np.concatenate([[0], np.cumsum(c)]) for c in (n0, n1))
    total0, total1 = int(c0[-1]), int(c1[-1])
    n = float(total0 + total1)
    w0, w1 = (n / (2.0 * float(t)) if t else INF for t in (total0, total1))
    least = max(min_leaf_floor, int(np.floor(n * min_leaf_share)))
    leaves, nodes = [], [(0, len(n0))]
    for depth in range(max_depth + 1):
        after = []
        for a, b in nodes:
            all0, all1 = int(c0[b] - c0[a]), int(c1[b] - c1[a])
            best = None
            if depth < max_depth and all0 and all1:
                l0, l1 = c0[a + 1 : b + 1] - c0[a], c1[a + 1 : b + 1] - c1[a]
                ok = (l0 + l1 >= least) & (all0 + all1 - l0 - l1 >= least)
                if ok.any():
                    score = _gini_mass(l0 * w0, l1 * w1) + _gini_mass((all0 - l0) * w0, (all1 - l1) * w1)
                    best = a + 1 + int(np.where(ok, score, INF).argmin())
            if best is None:
                leaves.append((a, b, int(all1 * w1 > all0 * w0)))
            else:
                after += [(a, best), (best, b)]
        nodes = after
    return leaves


def tree_confusion(num: np.ndarray, txt: np.ndarray, y: np.ndarray, train: np.ndarray, n: np.ndarray, max_depth: int) -> list[tuple[int, int, int]]:
    """(y, pred, n) of a feature's test rows under the tree that its train rows grow."""
    x = encoded(num, txt, n)
    values, at = np.unique(x[train], return_inverse=True)
    if not len(values):
        return []
    n0, n1 = (np.bincount(at, n[train] * (y[train] == c), len(values)).astype(np.int64) for c in (0, 1))
    pred = np.zeros(len(values), np.int64)
    for a, b, p in leaf_ranges(n0, n1, max_depth):
        pred[a:b] = p
    #: A leaf reaches up to its largest train value; what lies above all train values belongs to the last leaf.
    of = pred[np.minimum(np.searchsorted(values, x[~train], side="left"), len(values) - 1)]
    key, where = np.unique(y[~train] * 2 + of, return_inverse=True)
    return [(int(k // 2), int(k % 2), int(v)) for k, v in zip(key, np.bincount(where, n[~train], len(key)), strict=True)]


def feature_confusion(hist: DataFrame, max_depth: int) -> DataFrame:
    """(dataset, feature, y, pred, n) for every feature of a histogram."""
    schema = pa.schema([("dataset", pa.string()), ("feature", pa.string()), ("y", pa.int32()), ("pred", pa.int32()), ("n", pa.int64())])

    def score(rows: pa.Table) -> pa.Table:
        num = np.array([np.nan if v is None else v for v in rows.column("num").to_pylist()], float)
        txt = np.array(rows.column("txt").to_pylist(), object)
        y, n = rows.column("y").to_numpy().astype(np.int64), rows.column("n").to_numpy()
        train = np.array(rows.column("split").to_pylist(), object) == "train"
        found = tree_confusion(num, txt, y, train, n, max_depth)
        names = [rows.column(c)[0].as_py() for c in ("dataset", "feature")]
        return pa.Table.from_pylist([dict(zip(schema.names, (*names, *f), strict=True)) for f in found], schema=schema)

    return hist.groupBy("dataset", "feature").applyInArrow(score, "dataset string, feature string, y int, pred int, n bigint")


def single_feature_scores(df: DataFrame, features: list[str], dataset: str, label: str = "binary_label",
                          id_cols: list[str] | None = None, seed: int = 42, max_per_class: int = 30_000,
                          max_depth: int = 3) -> DataFrame:
    """(dataset, feature, single_feature_macro_f1) for every feature of one table."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    ids = id_cols or []
    valid = df.where(F.col(label).isNotNull())
    counts = valid.groupBy(label).count().collect()  # at most a few classes
    n_classes, min_count = len(counts), min((r["count"] for r in counts), default=0)
    if n_classes < 2 or min_count < 3 or not features:
        rows = [(dataset, f, None) for f in features]
        return spark.createDataFrame(rows, "dataset string, feature string, single_feature_macro_f1 double")
    # the balanced sample is bounded (classes x max_per_class rows); materialise it once
    sample = class_cap_sample(valid.select(label, *ids, *features), label, ids, seed=seed,
                              max_per_class=max_per_class, sample_size=None).checkpoint(eager=True)
    sample = random_stratified_split(sample, label, ids, seed=seed, test_size=0.30, val_share=1.0)
    conf = feature_confusion(audit_histogram(sample, features, label, dataset), max_depth).checkpoint(eager=True)
    scores = confusion_metrics(conf, ["dataset", "feature"])
    return scores.select("dataset", "feature", F.col("macro_f1").alias("single_feature_macro_f1"))


def audit_report(scores: DataFrame, membership: DataFrame, policy: str = "audited_metadata_main") -> DataFrame:
    """One row per (dataset, view, feature): class, score, action, note."""
    views = membership.where(F.col("policy") == policy).select(
        "dataset", "view_role", F.concat_ws("_", "view_role", "policy").alias("view"), "feature", "ordinal")
    rep = views.join(scores, ["dataset", "feature"], "left")
    low = norm_expr(F.col("feature"))
    is_hard = F.size(hard_reasons_expr(F.col("feature"))) > 0
    cls, action = feature_class_expr(is_hard, has_any_expr(low, LEGITIMATE_METADATA_TOKENS),
                                     has_any_expr(low, PROTOCOL_METADATA_TOKENS), F.col("single_feature_macro_f1"))
    rep = rep.withColumn("feature_class", cls).withColumn("action", action)
    return rep.select("dataset", "view", "view_role", "feature", "feature_class", "single_feature_macro_f1", "action",
                      audit_note_expr(F.col("feature_class"), F.col("single_feature_macro_f1")).alias("notes"))


def highly_discriminative(report: DataFrame, threshold: float = DISCRIMINATIVE_SCORE) -> DataFrame:
    """Score > 0.80 among the retained classes."""
    return report.where((F.col("single_feature_macro_f1") > threshold) & F.col("feature_class").isin(*DISCRIMINATIVE_CLASSES))
