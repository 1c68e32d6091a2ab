"""Leakage and view rules over a *columns table* ``(dataset, ordinal, column)``.

The rules are tables of fixed values in ``vocab``; here is the one matcher that reads them.  Every rule is a column
expression, so classifying the columns of any number of tables is one DataFrame job instead of a driver loop.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.names import has_any_expr, norm, norm_expr, parts_expr
from flowlens.vocab import (
    ANALYSIS_PARAMETER_EXACT, AUDIT_CLASSES, DISCRIMINATIVE_SCORE, HARD_LEAKAGE_RULES, HIGH_SCORE, LABEL_COLUMNS,
    LEGITIMATE_METADATA_TOKENS, MQTT_METADATA_TOKENS, NOTE_DISCRIMINATIVE, NOTE_LEGITIMATE, NOTE_NONE,
    PROTOCOL_METADATA_TOKENS, STRICT_EXCLUDE_TOKENS, STRICT_TOKENS,
)


def rule_matches(column: Column, rule: dict) -> Column:
    """Whether a column name falls under one row of a rule table."""
    name, parts = norm_expr(column), parts_expr(column)
    hits = []
    if "exact" in rule:
        hits.append(name.isin(*sorted({norm(x) for x in rule["exact"]})))
    if "substrings" in rule:
        hits.append(has_any_expr(name, rule["substrings"]))
    if "words" in rule:
        allowed = reduce(or_, [name.endswith(x) for x in rule.get("unless_ending", ())], F.lit(False))
        any_of = reduce(or_, [F.size(F.array_except(F.array(*map(F.lit, words)), parts)) == 0 for words in rule["words"]])
        hits.append(any_of & ~allowed)
    return reduce(or_, hits)


def hard_reasons_expr(column: Column) -> Column:
    """Sorted, distinct hard-leakage reasons of a column name (empty array if none)."""
    reasons = [F.when(rule_matches(column, rule), F.lit(reason)) for reason, rule in sorted(HARD_LEAKAGE_RULES.items())]
    return F.array_compact(F.array(*reasons))


def classify_columns(columns: DataFrame, column: str = "column") -> DataFrame:
    """Add rule flags to a columns table."""
    c = F.col(column)
    low = norm_expr(c)
    return (columns
            .withColumn("hard_reasons", hard_reasons_expr(c))
            .withColumn("is_hard", F.size("hard_reasons") > 0)
            .withColumn("is_label", c.isin(*LABEL_COLUMNS))
            .withColumn("is_analysis", low.isin(*ANALYSIS_PARAMETER_EXACT))
            .withColumn("is_legitimate", has_any_expr(low, LEGITIMATE_METADATA_TOKENS))
            .withColumn("is_protocol", has_any_expr(low, PROTOCOL_METADATA_TOKENS))
            .withColumn("broker_token", has_any_expr(low, MQTT_METADATA_TOKENS))
            .withColumn("strict_token", has_any_expr(low, STRICT_TOKENS) & ~has_any_expr(low, STRICT_EXCLUDE_TOKENS)))


def feature_class_expr(is_hard: Column, is_legit: Column, is_protocol: Column, score: Column) -> tuple[Column, Column]:
    """(feature_class, action) of an audited feature: the first kind of ``AUDIT_CLASSES`` that it is."""
    high = F.coalesce(score > HIGH_SCORE, F.lit(False))
    holds = {"hard": is_hard, "legitimate": is_legit, "protocol": is_protocol, "high": high, "other": F.lit(True)}
    first = F.coalesce(*[F.when(holds[kind], F.struct(F.lit(cls).alias("cls"), F.when(high, F.lit(if_high)).otherwise(F.lit(action)).alias("action")))
                         for kind, (cls, action, if_high) in AUDIT_CLASSES.items()])
    return first["cls"], first["action"]


def audit_note_expr(cls: Column, score: Column) -> Column:
    """What the report says about a score."""
    notes = [F.when((score > HIGH_SCORE) & (cls == AUDIT_CLASSES["legitimate"][0]), F.lit(NOTE_LEGITIMATE)),
             F.when(score > DISCRIMINATIVE_SCORE, F.lit(NOTE_DISCRIMINATIVE))]
    return F.coalesce(*notes, F.lit(NOTE_NONE))
