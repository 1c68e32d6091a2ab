"""ANSI-safe numeric coercion and null handling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number the way a pandas/Python float parser accepts it (Spark's try_cast
# would also accept suffixes such as '1d' or '1f', which must stay null).
NUMBER_PATTERN = r"^\s*[+-]?(((\d+(_\d+)*)?\.?\d+(_\d+)*|\d+(_\d+)*\.)([eE][+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$"


def coerce_double(c: Column) -> Column:
    """Coerce to double, turning NaN and +-inf into null."""
    text = F.lower(F.trim(c.cast("string")))
    value = F.when(text.rlike(NUMBER_PATTERN), F.regexp_replace(text, "_", "").try_cast("double"))
    return finite_or_null(value)


def finite_or_null(c: Column) -> Column:
    """NaN and +-inf become null (pandas treats them as missing)."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def safe_div(num: Column, den: Column, zero: Column | float | None = None) -> Column:
    """num / den, or ``zero`` (default null) when den is 0 or null."""
    fallback = zero if isinstance(zero, Column) else F.lit(zero).cast("double")
    return F.when(den.isNull() | (den == 0), fallback).otherwise(num / den)


def clean_token(c: Column, tokens=("-", "(empty)", "")) -> Column:
    """Zeek-style null tokens become null."""
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)
