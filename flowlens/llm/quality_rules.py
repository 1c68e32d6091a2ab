"""Quality rules with risk-controlled thresholds (operator 2).

The base rules are fixed.  Further rules compare a share with a cutoff that labelled rows select, for each
stratum (language) and rule on its own: exact binomial tests certify the cutoffs whose rate of rejected good documents
is below the rule's part of the allowed risk, corrected for testing many strata and rules.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import llm_query, stored
from flowlens.llm.words import Words, byte_set, grams

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_top_word")
#: rule -> (counted, out of, cutoffs from the laxest to the strictest level).  A document fails a rule if its share is
#: above the cutoff.  The levels are fixed beforehand, so that the tests are valid.
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)),
    "upper_words": ("n_upper_words", "n_words", (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45)),
    "top_word": ("n_top_word", "n_words", (0.95, 0.9, 0.8, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35)),
}
RISK, CONFIDENCE = 0.02, 0.95

_SYMBOL, _UPPER, _LOWER, _FOLLOW = byte_set(SYMBOLS), byte_set(range(65, 91)), byte_set(range(97, 123)), byte_set(range(0x80, 0xC0))


def text_counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one whole text; null and empty texts have none.

    n_upper_words: words with two or more A-Z and no a-z.  n_top_word: how often the commonest word occurs."""
    if not text:
        return (0,) * len(COUNTS)
    w = Words(text.encode())
    if not w.n:
        return (0,) * len(COUNTS)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line in seen:
            lines, dup = lines + 1, dup + 1
        elif line.strip(" \t\x0b\x0c\r"):
            lines += 1
            seen.add(line)
    g = grams(w.hash, 5)
    covered = np.zeros(w.n + 1, np.int64)
    if len(g):
        _, where, n = np.unique(g, return_inverse=True, return_counts=True)
        at = np.flatnonzero(n[where] > 1)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 5, -1)
    repeat = int((np.cumsum(covered[:-1]) > 0).sum())
    chars = len(w.letters) - int(_FOLLOW[w.letters].sum())
    upper = int(((w.count(_UPPER) >= 2) & (w.count(_LOWER) == 0)).sum())
    top = int(np.unique(w.hash, return_counts=True)[1].max())
    return w.n, chars, int(_SYMBOL[w.letters].sum()), dup, repeat, lines, upper, top


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``COUNTS`` and base_failed; row by row.  Columns of these names are replaced."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    def counts(texts: pa.Array) -> pa.Array:
        rows = [text_counts(t.as_py()) for t in texts]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))

    kept = [c for c in docs.columns if c not in (*COUNTS, "base_failed")]
    out = docs.withColumn("_counts", counts(F.col(text))).select(*kept, *[F.col("_counts")[c].alias(c) for c in COUNTS])
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p): the regularised incomplete beta function I(1-p; n-k, k+1), by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p

    def fraction(a, b, x):
        c, d = 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1.0))
        value = d
        for m in range(1, 100_000):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1.0 + top * d or 1e-300)
                c = 1.0 + top / c or 1e-300
                value *= c * d
            if abs(c * d - 1.0) < 1e-13:
                break
        return value

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1.0) / (a + b + 2.0) else 1.0 - front * fraction(b, a, 1.0 - x) / b


def certified(good: int, rejected: Sequence[int], risk: float, error: float) -> int:
    """How many levels, from the laxest on, are certified: each rejects the hypothesis "more than ``risk`` of the good
    documents fail" at level ``error``.  The levels are nested and tested in a fixed order up to the first failure, which
    needs no further correction among them."""
    done = 0
    for k in rejected:
        if good == 0 or at_most(int(k), int(good), risk) > error:
            break
        done += 1
    return done


def stratum_of(lang: Column) -> Column:
    """The stratum of a row: its language, null being one."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def fails(rule: str, cutoff: Column) -> Column:
    """Whether the rule's share is above ``cutoff``; never where that is null."""
    top, bottom, _ = RULES[rule]
    return F.coalesce((F.col(bottom) > 0) & (F.col(top) > cutoff * F.col(bottom)), F.lit(False))


def least_good(risk: float, error: float) -> int:
    """Good rows that a stratum needs: with fewer, not even a level that rejects none of them is certified."""
    return math.ceil(math.log(error) / math.log1p(-risk))


def select_levels(labelled: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> dict[str, dict[str, int]]:
    """stratum -> rule -> level, for the rules that have one.

    ``labelled`` has ``COUNTS``, _stratum and quality (1 good).  With the given confidence, the chosen levels of a stratum
    together fail at most ``risk`` of its good documents, in all strata at once: each rule gets an equal part of the risk, and
    the allowed error 1 - ``confidence`` is split among strata and rules (Bonferroni).  Strata with too few good rows for
    any certificate have none and take no part of the error.  Of a rule's certified levels the one that fails the
    most bad documents less good ones is taken, the laxest of equals; a rule that fails no more bad than good documents gets
    none.  One aggregate; the driver sees two rows for each stratum that is large enough.
    """
    failing = [F.count_if(fails(r, F.lit(c))).alias(f"{r}_{k}") for r, (_, _, cutoffs) in RULES.items() for k, c in enumerate(cutoffs)]
    share, error = risk / len(RULES), (1 - confidence) / len(RULES)
    counts = labelled.groupBy("_stratum", "quality").agg(F.count(F.lit(1)).alias("n"), *failing)
    rows = counts.where((F.col("quality") != 1) | (F.col("n") >= least_good(share, error))).collect()
    seen = {(row["_stratum"], row["quality"]): row for row in rows}
    large = sorted(s for s, q in seen if q == 1)
    levels: dict[str, dict[str, int]] = {}
    for s in large:
        good, bad = seen[s, 1], seen.get((s, 0))
        for rule, (_, _, cutoffs) in RULES.items():
            k = certified(good["n"], [good[f"{rule}_{i}"] for i in range(len(cutoffs))], share, error / len(large))
            gains = [bad[f"{rule}_{i}"] - good[f"{rule}_{i}"] for i in range(k)] if bad else []
            if gains and max(gains) > 0:
                levels.setdefault(s, {})[rule] = gains.index(max(gains))
    return levels


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text", **options) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """id_col, ``COUNTS``, base_failed, failed_rules and kept for every row, and the chosen levels.

    A row is kept unless the base rules or a rule at its stratum's level fail it.  Labelled rows that
    pass the base rules choose the levels; an id that is labelled twice counts once, as bad if any
    label says so, and null labels count nowhere.  With too few labels there are no levels, and the
    base rules decide alone.  Null and empty texts have no words; texts are read whole; repeated rows each have a row; an empty
    table gives none.
    """
    counted = docs.select(id_col, text, stratum_of(F.col(lang)).alias("_stratum"))
    counted = stored(with_counts(counted, text).drop(text), "rule-counts")
    one = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.min("quality").alias("quality"))
    labelled = counted.where(~F.col("base_failed")).join(one, F.col(id_col) == F.col("_label_id"))
    levels = select_levels(labelled, **options)
    cutoffs = [(s, *[float(RULES[r][2][of[r]]) if r in of else None for r in RULES]) for s, of in levels.items()]
    known = docs.sparkSession.createDataFrame(cutoffs, "_of string, " + ", ".join(f"_max_{r} double" for r in RULES))
    judged = counted.join(known, F.col("_stratum") == F.col("_of"), "left")
    rules = F.array_compact(F.array(*[F.when(fails(r, F.col(f"_max_{r}")), F.lit(r)) for r in RULES]))
    out = judged.withColumn("failed_rules", rules).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("_stratum", "_of", *[f"_max_{r}" for r in RULES]), levels


@llm_query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out, _ = apply_rules(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
