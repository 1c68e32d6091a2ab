"""Mixing: targets by water-filling, whole words taken, exact quotas, reruns that agree."""

import re
from collections import defaultdict

from flowlens.llm.mixing import mix_documents, mix_plan, mixed_rows, shard_quotas
from pyspark.sql import functions as F


def targets(sizes):
    """Targets by code point order, weights 3, 1, 2, shared until none is above twice its size."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        for s in above:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def sample(n=600):
    return [(k, ("w%d " % k) * (k % 37), None if k % 11 == 0 else "src%d" % (0 if k % 3 == 0 else k % 7)) for k in range(n)] + [(n, None, "é"), (n + 1, "one", "Z"), (n + 2, "big " * 5000, "src1")]


def test_plan(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mix_plan(docs, words_per_shard=2000).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total, of = defaultdict(int), {i: s for i, _, s in rows}
    for i, s in of.items():
        total[s] += size[i]
    want, taken = targets(total), defaultdict(int)
    assert len(plan) == len(rows)
    for r in plan:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[of[r["doc_id"]]] and 0 <= r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - want[of[r["doc_id"]]]) < 1e-6
        assert r["taken"] == sum(d["words"] for d in (r["first"], r["second"]) if d)
        assert all(d["shard"] is not None for d in (r["first"], r["second"]) if d)
        taken[of[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    again = mix_plan(docs.repartition(7), words_per_shard=2000).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, again))


def test_quotas_are_exact(spark):
    blocks = spark.createDataFrame([(0, 100), (1, 1), (2, 37), (3, 400)], "no long, n long")
    rows = shard_quotas(blocks, 16, seed=3).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in rows:
        by_source[r["no"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert dict(by_source) == {0: 100, 1: 1, 2: 37, 3: 400}
    assert [by_shard[j] for j in range(16)] == [538 * (j + 1) // 16 - 538 * j // 16 for j in range(16)]


def test_drawn_counts_are_hypergeometric_on_average(spark):
    blocks = spark.createDataFrame([(0, 30), (1, 10)], "no long, n long")
    left = [sum(r["n"] for r in shard_quotas(blocks, 2, seed=s).where("shard = 0 AND no = 1").collect()) for s in range(12)]
    assert 3 <= sum(left) / len(left) <= 7 and len(set(left)) > 1


def test_documents_of_the_mix_are_whole_and_at_most_doubled(spark):
    rows = sample(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mix_documents(docs)
    text = {i: t for i, t, _ in rows}
    assert mix.columns == docs.columns
    n = defaultdict(int)
    for r in mix.collect():
        assert r["text"] == text[r["doc_id"]]
        n[r["doc_id"]] += 1
    assert max(n.values()) == 2


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s")] * 5 + [(None, "a b", None)] * 3 + [(2, None, "t")], "doc_id long, text string, source string")
    plan = mix_plan(docs).collect()
    assert len(plan) == 9 and sum(r["taken"] for r in plan) == 39
    mix_documents(docs).collect()


def test_the_mix_is_the_trees_output(spark):
    """Every draw that counts is a row with the shard and place of the plan, and shards come whole and in order."""
    docs = spark.createDataFrame(sample(), "doc_id long, text string, source string")
    plan = mix_plan(docs, words_per_shard=2000).collect()
    want = sorted((r["doc_id"], d["shard"], d["place"]) for r in plan for d in (r["first"], r["second"]) if d and 2 * d["words"] >= r["size"])
    rows = mixed_rows(docs, words_per_shard=2000).select("row.doc_id", "shard", "place").collect()
    assert sorted(map(tuple, rows)) == want and len({r["shard"] for r in rows}) > 4
    place = {}
    for i, shard, at in want:
        place.setdefault(i, []).append((shard, at))
    mix = mix_documents(docs, words_per_shard=2000).withColumn("part", F.spark_partition_id()).collect()
    seen, parts = {}, {}
    for r in mix:
        parts.setdefault(r["part"], []).append(r["doc_id"])
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {i: len(v) for i, v in place.items()}
    by_shard = {}
    for i, shard, at in want:
        by_shard.setdefault(shard, []).append((at, i))
    runs = {s: [i for _, i in sorted(v)] for s, v in by_shard.items()}
    for ids in parts.values():
        while ids:
            run = next(r for r in runs.values() if ids[: len(r)] == r)
            ids = ids[len(run) :]


def test_shared_ids_and_columns_named_like_the_operators_own(spark):
    names = ["row", "id", "size", "shard", "place", "d", "j", "i", "k", "_words", "_rows", "_times", "of"]
    rows = [(k % 3 if k % 4 else None, "a b c d e " * 3, "s", *[f"{c}{k}" for c in names]) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    mix = mix_documents(docs)
    assert mix.columns == docs.columns
    got = [tuple(r) for r in mix.collect()]
    assert set(got) <= set(rows) and len(got) == 36 and max(got.count(r) for r in set(got)) <= 2
