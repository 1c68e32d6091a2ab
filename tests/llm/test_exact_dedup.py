"""Exact dedup against plain grouping, with sound and with weak chunk identifiers."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from flowlens.llm.exact_dedup import chunks, exact_groups, keep_first_copies


def sample():
    rng = random.Random(2)
    long = [" ".join(rng.choice(["alpha", "beta", "come", "due", "é😀", "x"]) for _ in range(n)) for n in (3, 400, 3000, 30_000)]
    texts = [*long, *[t.replace(" ", "\n\t ") for t in long], long[3][:-1], long[3] + " ", None, "", " ", "  ", "a b", "a  b", "ab", "a b", long[2], "z" * 40_000]
    return [(100 - k, t) for k, t in enumerate(texts)] + [(100, long[0])]


def brute(rows):
    norm = {}
    for i, t in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return sorted((i, min(g), len(g), i == min(g), hashlib.sha256(x.encode()).hexdigest()) for x, g in norm.items() for i in g)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_groups(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string")
    assert got(exact_groups(docs)) == brute(sample())


def test_unverified_identifiers_never_join_different_texts(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string")
    assert got(exact_groups(docs, identify=lambda c: F.length(c).cast("long") % 2)) == brute(sample())


def test_chunks_make_up_the_text(spark):
    docs = spark.createDataFrame([(t or "",) for _, t in sample()], "text string")
    rows = docs.select("text", chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r["c"]) == r["text"] and all(len(c) <= 8192 for c in r["c"]) for r in rows)


def test_kept_rows_have_all_columns_once(spark):
    rows = [(3, "a  b", "x"), (2, "a b", "y"), (2, "a b", "y"), (5, None, "z"), (None, "q", "w")]
    kept = keep_first_copies(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in kept) == [(-1, "w"), (2, "y"), (5, "z")]


def test_shared_and_null_ids_lose_no_text_and_keep_no_copy(spark):
    rows = [(None, "one"), (None, "two"), (None, "three  x"), (None, "three x"), (None, "four"), (7, "p"), (7, "q"), (7, "q"), (8, "q"), (9, "four"), (9, "five"), (6, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or -1, " ".join(r["text"].split())) for r in keep_first_copies(docs.repartition(3)).collect())
    assert kept == [(-1, "one"), (-1, "three x"), (-1, "two"), (6, "p"), (7, "q"), (9, "five"), (9, "four")]
    assert sorted(map(str, keep_first_copies(docs).collect())) == sorted(map(str, keep_first_copies(docs.repartition(5)).collect()))


def test_columns_named_like_the_operators_own(spark):
    names = ["row", "id", "sha", "kept", "kept_id", "n", "_rows", "_kept_id", "_sha", "_doc", "_text"]
    docs = spark.createDataFrame([(k, f"text {k // 2}", *[f"{c}{k}" for c in names]) for k in range(4)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(k, f"text {k // 2}", *[f"{c}{k}" for c in names]) for k in (0, 2)]
