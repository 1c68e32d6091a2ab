"""Label normalisation as plain column expressions (no UDFs)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.numeric import NUMBER_PATTERN
from flowlens.vocab import BENIGN_TOKENS, FILENAME_BENIGN_TOKENS, NULL_LABEL_TOKENS


def _contains_any(text: Column, tokens) -> Column:
    out = F.lit(False)
    for token in tokens:
        out = out | text.contains(token)
    return out


def label_to_binary(c: Column, match: str = "substring", label_map: Mapping[str, int] | None = None,
                    default: int | None = None) -> Column:
    """Map a raw label to 0 (benign), 1 (attack) or null (undetermined).

    Order of the rules: null-like text -> null; exact benign token -> 0;
    false/f -> 0; true/t -> 1; a number -> 0 when it is zero else 1; benign
    token inside the text -> 0; everything else -> 1.

    ``match="substring"`` reproduces the original behaviour where short
    tokens such as ``no`` or ``0`` also hit words like ``anomaly``;
    ``match="token"`` only accepts whole words.  ``label_map`` maps lower-cased
    labels explicitly; unmapped labels fall back to ``default`` when given,
    else to the rules.
    """
    text = F.lower(F.trim(c.cast("string")))
    rules = (
        F.when(c.isNull() | text.isin(*NULL_LABEL_TOKENS), F.lit(None).cast("int"))
        .when(text.isin(*BENIGN_TOKENS), F.lit(0))
        .when(text.isin("false", "f"), F.lit(0))
        .when(text.isin("true", "t"), F.lit(1))
        .when(text.rlike(NUMBER_PATTERN),
              F.when(F.regexp_replace(text, "_", "").try_cast("double") == 0, F.lit(0)).otherwise(F.lit(1)))
    )
    if match == "substring":
        rules = rules.when(_contains_any(text, BENIGN_TOKENS), F.lit(0))
    elif match == "token":
        words = F.split(text, "[^0-9a-z_]+")
        rules = rules.when(F.arrays_overlap(words, F.array(*[F.lit(t) for t in BENIGN_TOKENS])), F.lit(0))
    else:
        raise ValueError(f"unknown match mode {match!r}")
    rules = rules.otherwise(F.lit(1))
    if label_map:
        mapped = F.create_map(*[x for k, v in label_map.items() for x in (F.lit(str(k).lower()), F.lit(int(v)))])
        fallback = F.lit(default) if default is not None else rules
        return F.when(text.isin(*[str(k).lower() for k in label_map]), mapped[text]).otherwise(
            F.when(c.isNull(), F.lit(None)).otherwise(fallback)).cast("int")
    return rules.cast("int")


def label_from_filename(path: Column) -> Column:
    """Stem of a file path, or ``benign`` when it names normal traffic."""
    stem = F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    low = F.lower(stem)
    return F.when(_contains_any(low, FILENAME_BENIGN_TOKENS), F.lit("benign")).otherwise(stem)


def zeek_binary(label: Column) -> Column:
    """Zeek rule: 0 when the lower-cased label mentions benign, else 1."""
    return F.when(F.lower(F.trim(label)).contains("benign"), F.lit(0)).otherwise(F.lit(1))


def zeek_multiclass(label: Column, detailed: Column) -> Column:
    """benign, else the detailed label when present and not '-', else the label."""
    low = F.lower(F.trim(label))
    det = F.trim(detailed)
    return (F.when(low.contains("benign"), F.lit("benign"))
            .when(det.isNotNull() & (det != "") & (det != "-"), det)
            .otherwise(low))
