"""Periodic runs against all periods and stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
from flowlens.llm.common import LLM_QUERIES
from flowlens.llm.periodic_runs import periodic_runs, runs_of


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(words):
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    start, length, period = best or (None, None, None)
    return (len(runs), start, length, period, 1000 * length // period if best else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sample(n, longest=60):
    rng, out = random.Random(n), []
    for _ in range(n):
        size, kinds, words = rng.randint(1, longest), rng.randint(1, 4), []
        while len(words) < size:
            if rng.random() < 0.3:
                words += [rng.randrange(kinds) for _ in range(rng.randint(1, 6))] * rng.randint(2, 8)
            else:
                words.append(rng.randrange(kinds))
        out.append(words)
    return out


def test_runs_equal_brute_force():
    for words in sample(3000):
        assert runs_of(np.array(words)) == brute(words)


def test_long_texts_with_and_without_runs():
    assert runs_of(np.resize(np.arange(700), 50_000)) == [(0, 50_000, 700)]
    assert runs_of(np.zeros(50_000, int)) == [(0, 50_000, 1)]
    assert runs_of(np.array([w for k in range(10_000) for w in (1, 2, 3, 4, 5, 6, 100 + k)])) == []


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_odd_texts_repeated_rows_and_other_columns(spark):
    texts = [None, "", " \t\n", "one", "a a a a a a", "a b a b a b a b a b a b", "é " * 9 + "x y " * 5, "z " * 30_000 + "end"]
    texts += [" ".join(map(str, w)) for w in sample(200)]
    rows = [(k % 150, t, f"s{k}", "mine") for k, t in enumerate(texts + texts[:3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, _runs string").repartition(3)
    got = {}
    for r in periodic_runs(docs.withColumnRenamed("start", "mark")).collect():
        assert r["_runs"] == "mine"
        got[r["mark"]] = tuple(r[c] for c in FIELDS)
    assert got == {f"s{k}": expected(words_of(t)) for k, t in enumerate(texts + texts[:3])}
    replaced = periodic_runs(docs)
    assert replaced.columns == ["doc_id", "text", "_runs", *FIELDS] and dict(replaced.dtypes)["start"] == "bigint"


def test_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in LLM_QUERIES["op13_periodic_runs"](spark, sf).collect()}
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words, h = words_of(text), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if len(words) <= 2500:
            assert got[doc_id] == expected(words)


def test_empty_table(spark, empty_sf):
    out = LLM_QUERIES["op13_periodic_runs"](spark, empty_sf)
    assert out.columns == ["doc_id", *FIELDS] and out.count() == 0
