"""Personal data by weak supervision (operator 9, built-in functions only).

Base patterns always report.  Weaker candidates are voted on by labelers (pattern, gazetteer and
context); expectation-maximisation over the votes estimates how reliable each labeler is, and a
span classifier trained on the resulting probabilities decides which candidates are reported.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import llm_query, stored
from flowlens.llm.spans import span_digest

BASE_KINDS = ("email", "ip", "card", "phone")
#: Base patterns.  A match can only begin where no longer one could (or where the last match ended), which keeps the
#: leftmost matches and makes the search linear; quantifiers are possessive where nothing can be given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "phone": "+"}

#: Gazetteers and context words of the labelers; a given name before a capitalised word also proposes a person.
GIVEN_NAMES = ("Anna", "Carlos", "David", "Elena", "Hans", "James", "John", "Juan", "Julia", "Laura", "Marie", "Mary", "Michael", "Paul", "Peter", "Robert", "Sarah", "Thomas")
MAIL_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk")
FOR_CONTEXT = r"(?i)\b(?:call|phone|tel|telephone|mobile|contact|fax|whatsapp|ssn|social security|mail|e-mail|email|write to|dear|name|regards|signed|born|patient|customer)\b"
AGAINST_CONTEXT = r"(?i)\b(?:order|invoice|isbn|issn|version|part|serial|sku|total|amount|ticket|figure|table|page|example|sample|test)\b"

WEAK_KINDS = ("local_phone", "id_number", "spelled_email", "person")
_SURNAME = r"\x20\p{Lu}[\p{L}\p{M}]++(?:['\u2019-]\p{Lu}[\p{L}\p{M}]++)*+"
WEAK_PATTERNS = {
    "local_phone": r"(?=[(0-9])(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "id_number": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{2,}+\x20?[(\[]dot[)\]]\x20?[A-Za-z]{2,}+",
    "person": rf"(?<![\p{{L}}\p{{M}}])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?{_SURNAME}(?:{_SURNAME})?|(?:{'|'.join(GIVEN_NAMES)}){_SURNAME})",
}
LABELERS = ("form", "gazetteer", "context", "digits", "near")
REACH = 60
THRESHOLD = 0.9


def spans_of(text: Column, kind: str, pattern: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """Array of (kind, start, end, found) of a pattern's matches in ``text`` (not null), in code points.

    The text split at the matches gives the lengths between them; their running sum gives the places."""
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["g"])
        end = start + F.length(z["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), z["m"].alias("found"))
        more = F.array(span) if valid is None else F.filter(F.array(span), lambda s: valid(s["found"]))
        return F.when(z["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["spans"], more).alias("spans")))

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,found:string>>")
    found = F.aggregate(zipped, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), step)["spans"]
    return F.when(F.contains(text, F.lit(HINTS[kind])), found).otherwise(none) if kind in HINTS else found


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid_ip(found: Column) -> Column:
    def part(p: Column) -> Column:
        value = F.ltrim(p, F.lit("0"))
        return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))

    return F.forall(F.split(found, r"\."), part)


VALID = {
    "email": None,
    "ip": valid_ip,
    "card": lambda m: F.when(F.length(digits_of(m)).between(14, 19), luhn(digits_of(m))).otherwise(False),
    "phone": lambda m: F.length(digits_of(m)).between(10, 15),
}


def votes(text: Column, span: Column, others: Column) -> list[Column]:
    """Each labeler's vote on a span: 1 personal, -1 not, 0 no opinion.

    form: kinds whose punctuation alone is telling.  gazetteer: given names and mail endings.
    context: words in the ``REACH`` characters before it.  digits: a run of one digit, or few
    different ones, is a placeholder.  near: a base span of the same text within 3 ``REACH``.
    """
    kind, found = span["kind"], span["found"]
    before = F.substr(text, F.greatest(span["start"] - REACH, F.lit(0)).cast("int") + 1, F.least(span["start"], F.lit(REACH)).cast("int"))
    form = F.when(kind.isin("email", "phone", "card", "id_number", "spelled_email"), 1).when(kind == "ip", 0).otherwise(0)
    named = F.when(kind == "person", F.when(found.rlike(r"\b(?:" + "|".join(GIVEN_NAMES) + r")\b"), 1).otherwise(0))
    named = named.when(kind.isin("email", "spelled_email"), F.when(found.rlike(r"(?i)(?:" + "|".join(MAIL_ENDS) + r")$"), 1).otherwise(-1)).otherwise(0)
    context = F.when(before.rlike(FOR_CONTEXT), 1).when(before.rlike(AGAINST_CONTEXT), -1).otherwise(0)
    digits = digits_of(found)
    different = F.array_size(F.array_distinct(F.split(digits, "")))
    number = F.when(F.length(digits) < 7, 0).when(different <= 3, -1).otherwise(1)
    close = F.when(F.exists(others, lambda o: (o["start"] != span["start"]) & (o["start"] < span["end"] + 3 * REACH) & (o["end"] > span["start"] - 3 * REACH)), 1).otherwise(0)
    return [form, named, context, number, close]


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, _base (spans of the base kinds), _weak and _voted (all spans, with votes).

    Weak candidates that meet a base span are part of it and left out.  Null texts count as empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(id_col), whole.alias("_text"))
    out = out.withColumn("_base", F.concat(*[spans_of(F.col("_text"), k, PATTERNS[k], VALID[k]) for k in BASE_KINDS]))
    weak = F.concat(*[spans_of(F.col("_text"), k, WEAK_PATTERNS[k]) for k in WEAK_KINDS])
    out = out.withColumn("_weak", F.filter(weak, lambda w: ~F.exists(F.col("_base"), lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"]))))

    def voted(span: Column) -> Column:
        cast = [v.cast("int").alias(n) for v, n in zip(votes(F.col("_text"), span, F.col("_base")), LABELERS, strict=True)]
        return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), *cast)

    return out.withColumn("_voted", F.transform(F.concat("_base", "_weak"), voted)).select(id_col, "_voted")


Pattern = tuple[str, tuple[int, ...]]


def reliabilities(patterns: dict[Pattern, int], rounds: int = 100) -> tuple[float, list[float], dict[Pattern, float]]:
    """Expectation-maximisation over vote patterns: the share of personal spans, each labeler's chance to be
    right when it votes, and each pattern's chance to be personal.

    Votes are taken as independent given the truth, all labelers start at 0.75 and stay above 0.5 and below 0.99.
    """
    share, right = 0.5, [0.75] * len(LABELERS)
    chance: dict[Pattern, float] = {}
    for _ in range(rounds):
        for p in patterns:
            yes, no = math.log(share), math.log(1 - share)
            for v, r in zip(p[1], right, strict=True):
                if v:
                    yes += math.log(r if v > 0 else 1 - r)
                    no += math.log(1 - r if v > 0 else r)
            chance[p] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
        total = sum(patterns.values())
        share = min(0.99, max(0.01, (sum(n * chance[p] for p, n in patterns.items()) + 1) / (total + 2)))
        for j in range(len(right)):
            cast = sum(n for p, n in patterns.items() if p[1][j])
            agree = sum(n * (chance[p] if p[1][j] > 0 else 1 - chance[p]) for p, n in patterns.items() if p[1][j])
            right[j] = min(0.99, max(0.51, (agree + 1.5) / (cast + 2)))
    return share, right, chance


def vector(kind: str, cast: Sequence[int]) -> list[float]:
    """Features of the span classifier: an intercept, the votes for and against, and the kind."""
    return [1.0, *[float(v > 0) for v in cast], *[float(v < 0) for v in cast], *[float(kind == k) for k in WEAK_KINDS]]


def train(patterns: dict[Pattern, int], chance: dict[Pattern, float], rounds: int = 3000, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Logistic regression on the probabilities of the patterns, weighted by 1 + log of their counts; full gradient steps."""
    rows = [(vector(*p), chance[p], 1 + math.log(n)) for p, n in sorted(patterns.items())]
    weights = [0.0] * len(vector("", [0] * len(LABELERS)))
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(rounds if rows else 0):
        slope = [decay * w for w in weights]
        for x, y, n in rows:
            error = n / total * (1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(weights, x, strict=True)))))) - y)
            slope = [s + error * a if a else s for s, a in zip(slope, x, strict=True)]
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def span_score(span: Column, weights: Sequence[float]) -> Column:
    """The classifier as a column expression."""
    cast = [span[n] for n in LABELERS]
    terms = [F.lit(1.0), *[(v > 0).cast("double") for v in cast], *[(v < 0).cast("double") for v in cast], *[(span["kind"] == k).cast("double") for k in WEAK_KINDS]]
    total = F.lit(0.0)
    for w, t in zip(weights, terms, strict=True):
        total = total + F.lit(float(w)) * t
    return 1 / (1 + F.exp(-total))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, dict[str, float]]:
    """id_col and personal, an array of (kind, start, end), for every row; and the labelers' reliabilities.

    All base spans are reported, and the weak candidates that the classifier gives ``threshold`` or
    more.  Texts are searched once; the driver sees one row per vote pattern, of which there
    are at most 3^5 for each kind whatever the corpus.
    """
    voted = stored(candidates(docs, id_col, text), "pii-votes")
    rows = voted.select(F.explode("_voted").alias("s")).groupBy("s.kind", *[f"s.{n}" for n in LABELERS]).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = {(r["kind"], tuple(r[n] for n in LABELERS)): r["n"] for r in rows}
    _, right, chance = reliabilities(patterns) if patterns else (0.5, [0.75] * len(LABELERS), {})
    weights = train(patterns, chance)
    kept = F.filter("_voted", lambda s: s["kind"].isin(*BASE_KINDS) | (span_score(s, weights) >= threshold))
    plain = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return voted.select(id_col, plain.alias("personal")), dict(zip(LABELERS, right, strict=True))


@llm_query("op9_personal_data")
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    columns = span_digest("personal", BASE_KINDS, WEAK_KINDS)
    return found.select("doc_id", *[c.alias(n) for n, c in columns.items()])
