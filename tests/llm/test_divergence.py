"""Source divergence against plain counting."""

import random
import re
from collections import Counter

import pytest
from flowlens.llm import divergence
from flowlens.llm.common import LLM_QUERIES
from flowlens.llm.divergence import divergence_audit


def expected(rows, least=10, top=10):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        found = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in found.items() if n >= least]

        def shares(words):
            n = Counter(w for w in words if w in set(kept))
            total = sum(n.values())
            return n, {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        _, q = shares([w for d in own for w in d[2]])
        of = {s: shares([w for d in own if d[1] == s for w in d[2]]) for s in {d[1] for d in own}}
        for s, (n, p) in of.items():
            pairs = [(t, sum((p[k] - of[t][1][k]) ** 2 // (p[k] + of[t][1][k]) for k in kept)) for t in of if t != s]
            terms = [(k, (p[k] - q[k]) ** 2 // (p[k] + q[k])) for k in kept if n[k] and p[k] > q[k]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def result(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def sample():
    rng, rows = random.Random(2), []
    vocabulary = ["the", "The", "of", "résumé", "École", "z\U0001f600", "don't", "x,y", "x.", "x", "e-mail", "A1b2", "_q_", "[w]", " n", "1234", "--"] + [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    for _ in range(900):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "b", "c", None])
        rows.append((lang, source, rng.choice([" ", "\n", "\t ", ". "]).join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 25)))))
    rows += [("en", "a", None), ("en", "blank", ""), ("xx", "p", "12 34"), ("xx", "q", None), ("yy", "only", "few words"), ("en", "long", "the of " * 60_000)]
    return rows + rows[:40]


@pytest.mark.parametrize("docs_a_block", [7, 4000])
def test_audit_equals_plain_counting(spark, monkeypatch, docs_a_block):
    monkeypatch.setattr(divergence, "BLOCK_DOCS", docs_a_block)
    monkeypatch.setattr(divergence, "AUDIT_CELLS", 200 if docs_a_block == 7 else 500_000)  # many tasks, or one
    rows = sample()
    docs = spark.createDataFrame([(*r, "mine", 1) for r in rows], "lang string, source string, text string, term string, n long").repartition(4)
    assert result(divergence_audit(docs)) == expected(rows)


def test_other_bounds(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert result(divergence_audit(docs, least_docs=40, top=3)) == expected(rows, 40, 3)


def test_query_against_plain_counting(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()]
    assert result(LLM_QUERIES["op12_source_divergence"](spark, sf)) == expected(rows)


def test_empty_table(spark, empty_sf):
    assert LLM_QUERIES["op12_source_divergence"](spark, empty_sf).count() == 0
