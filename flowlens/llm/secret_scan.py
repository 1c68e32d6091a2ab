"""Secret scan with multipart credential linking (operator 7).

Strong patterns report what they find.  Weak parts of a credential, which would be noise alone, are
reported only when complementary parts lie in the same scope: an interval join of access
identifiers, secrets and endpoints finds them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import llm_query
from flowlens.llm.spans import SPANS, span_digest

#: Fixed base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")

#: Weak parts: a named account, a mixed token of 16 characters or more, an address.
ACCOUNT = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
ACCOUNT_WORDS = ("user", "login", "account", "client")
BLOB = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:@-]{3,}", re.ASCII)
WEAK_KINDS = ("account", "blob", "endpoint")

#: kind -> part of a credential, and the parts that must lie in a weak kind's scope.
PART = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
NEEDS = {"blob": ("identifier",), "account": ("secret",), "endpoint": ("identifier", "secret")}
REACH = 200

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base kinds, leftmost and non-overlapping per kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def is_mixed(token: str) -> bool:
    """Whether a token has upper case, lower case and digits, and few repeats: what a generated key looks like."""
    kinds = (any(c.isupper() for c in token), any(c.islower() for c in token), any(c.isdigit() for c in token))
    return all(kinds) and len(set(token)) >= min(16, len(token) // 2)


class Intervals:
    """Intervals that answer whether one of them meets a scope."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.furthest = list(accumulate((b for _, b in spans), max))

    def meet(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, end)
        return k > 0 and self.furthest[k - 1] >= start


def linked_spans(base: list[Span], weak: list[Span], reach: int = REACH) -> list[Span]:
    """The weak spans whose complementary parts all lie within ``reach`` characters.

    Parts are joined by interval, each weak span against the sorted intervals of the parts it needs,
    so a document costs n log n for n spans.  A weak span that meets a base span is part of it and is not reported.
    """
    taken = Intervals((a, b - 1) for _, a, b in base)
    weak = [s for s in weak if not taken.meet(s[1], s[2] - 1)]
    parts = {p: Intervals((a, b) for k, a, b in (*base, *weak) if PART[k] == p) for p in ("identifier", "secret", "endpoint")}
    return [s for s in weak if all(parts[p].meet(s[1] - reach, s[2] + reach) for p in NEEDS[s[0]])]


def secret_spans(text: str | None, reach: int = REACH) -> list[Span]:
    """All reported spans of a whole text, in code points; null and empty texts have none."""
    if not text:
        return []
    base = base_spans(text)
    low = text.lower()
    weak: list[Span] = []
    if any(w in low for w in ACCOUNT_WORDS):
        weak += [("account", m.start(1), m.end(1)) for m in ACCOUNT.finditer(text)]
    if weak or any(k == "access" for k, _, _ in base):  # else no weak part can be complemented
        weak += [("blob", m.start(), m.end()) for m in BLOB.finditer(text) if is_mixed(m[0])]
        weak += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    return base + linked_spans(base, weak, reach) if weak else base


def find_secrets(text: Column, reach: int = REACH) -> Column:
    """Array of (kind, start, end) of a text's secrets, evaluated row by row."""

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(t.as_py(), reach)] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return scan(text)


def with_secrets(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with secrets, the array of spans (a column of this name is replaced); repeated rows each get theirs."""
    return docs.withColumn("secrets", find_secrets(F.col(text), reach))


@llm_query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    columns = span_digest("secrets", BASE_KINDS, WEAK_KINDS)
    return found.select("doc_id", *[c.alias(n) for n, c in columns.items()])
