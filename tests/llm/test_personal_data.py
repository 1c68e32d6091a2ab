"""Personal data: base spans against plain patterns, expectation-maximisation, and weak spans."""

import random
import re

from flowlens.llm.personal_data import BASE_KINDS, LABELERS, WEAK_KINDS, candidates, find_personal_data, reliabilities
from flowlens.llm.spans import span_digest

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def brute(t):
    out = []
    for n, (k, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            bad = (k == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (k == "card" and not (14 <= len(digits) <= 19 and luhn(digits))) or (k == "phone" and not 10 <= len(digits) <= 15)
            out += [] if bad else [(m.start(), n, m.end(), k)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def digests(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, right = find_personal_data(docs)
    columns = span_digest("personal", BASE_KINDS, WEAK_KINDS)
    return {r["doc_id"]: r for r in found.select("doc_id", *[c.alias(n) for n, c in columns.items()]).collect()}, right


def test_base_spans(spark):
    rng = random.Random(5)
    parts = ["1", "2", "34", "5 ", "-", "+1", "+", "(", ")", " ", ".", "@", "a", "b.c", "255.", "256.1", "0", "é", "😀", "1.2.3.4", "4111 1111 1111 1111", "_", "%", "+1 (212) 555-0100", "x@y.de"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None, "", "1 " * 20_000, "a@b" + ".c" * 20_000]
    got, _ = digests(spark, texts)
    for k, t in enumerate(texts):
        base = ",".join(s for s in got[k]["spans"].split(",") if s.split(":")[0] in BASE_KINDS)
        assert base == brute(t or ""), t


def test_weak_spans_need_support(spark):
    texts = [f"please call (212) 555-{k:04d} or mail p{k}@example.com, phone +1 (212) 555-{k:04d}" for k in range(150)]
    texts += [f"order total 111-11-1111 invoice 000.000.0000 ref {k}" for k in range(100)] + ["plain words and 12 numbers 3 only"] * 50
    got, right = digests(spark, texts)
    assert set(right) == set(LABELERS) and all(0.5 < r < 1 for r in right.values())
    assert "local_phone" in got[0]["spans"]
    assert all(not got[k]["spans"] for k in range(150, 300))


def test_expectation_maximisation_finds_the_bad_labeler():
    rng, patterns = random.Random(9), {}
    for _ in range(5000):
        truth = 1 if rng.random() < 0.4 else -1
        cast = tuple(truth if rng.random() < p else -truth for p in (0.95, 0.9, 0.9, 0.85, 0.55))
        patterns["x", cast] = patterns.get(("x", cast), 0) + 1
    share, right, _ = reliabilities(patterns)
    assert abs(share - 0.4) < 0.05
    assert all(abs(r - p) < 0.05 for r, p in zip(right, (0.95, 0.9, 0.9, 0.85, 0.55), strict=True))


def test_weak_candidates_are_whole(spark):
    """Names and spelled addresses of any length and alphabet, with or without a title."""
    long = "x" * 300
    texts = ["Mr. José García-Núñez wrote", "ask Anna Schmidt today", "Dr Müller", "Prof. " + "A" + "b" * 90 + " said", f"{long} [at] {long} (dot) education", "Johnny Walker", "Annapolis Road"]
    want = ["Mr. José García-Núñez", "Anna Schmidt", "Dr Müller", "Prof. " + "A" + "b" * 90, f"{long} [at] {long} (dot) education", None, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][v["start"] : v["end"]] for v in r["_voted"]] for r in candidates(docs).collect()}
    assert got == {k: [w] if w else [] for k, w in enumerate(want)}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com"), (1, "mail a@b.com"), (None, None)], "doc_id long, text string")
    found, _ = find_personal_data(docs)
    assert sorted(len(r["personal"]) for r in found.collect()) == [0, 1, 1]
    assert find_personal_data(docs.limit(0))[0].count() == 0
