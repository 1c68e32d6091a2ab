"""Digest columns over arrays of spans (kind, start, end): counts, joined text, SHA-256."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def in_order(spans: Column, kinds: Sequence[str]) -> Column:
    """Spans by start, then by the place of their kind in ``kinds``, then by end."""
    names = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; '' for none."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def span_digest(spans: str, base: Sequence[str], more: Sequence[str]) -> dict[str, Column]:
    """n_<kind> for each base kind, base_sha256 and spans, from the array column ``spans``."""
    everything = in_order(F.col(spans), [*base, *more])
    out = {f"n_{k}": F.size(of_kinds(F.col(spans), [k])).cast("long") for k in base}
    out["base_sha256"] = F.sha2(joined(of_kinds(everything, base)), 256)
    out["spans"] = joined(everything)
    return out
