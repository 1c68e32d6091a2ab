"""SimHash fingerprints and groups against plain counting and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from flowlens.llm.common import LLM_QUERIES
from flowlens.llm.simhash import simhash_groups, spanning_links, vantage_shards


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 3):
            parent[root(i)] = root(i + 1 + int(j))
    return [root(i) for i in range(len(fps))]


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    comp = components(fps)
    ids = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            ids[c] = min(i, ids.get(c, i))
    return sorted(((i, f"{f:016x}", ids.get(c)) for (i, _), f, c in zip(rows, fps, comp)), key=str)


def sample():
    rng, texts = random.Random(8), []
    for n in (3, 10, 60, 300):
        for _ in range(12):
            base = [f"w{rng.randint(0, 99)}" for _ in range(n)]
            for _ in range(8):
                x = list(base)
                for _ in range(rng.randint(0, 2)):
                    x[rng.randrange(n)] = f"z{rng.randint(0, 5)}"
                texts.append(" ".join(x))
    texts += [None, "", " \n", "One", "one", "A\tb", "a b", "É b c", "é b c"] + ["a copy that stays as it is"] * 30 + ["x " * 200_000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return list(zip(order, texts)) + [(None, "One"), (None, "a row of its own without an id"), (3, "an id that another row has")]


@pytest.mark.parametrize(("leaf", "block"), [(16, 8), (4096, 16384)])
def test_groups_equal_all_pairs(spark, leaf, block):
    rows = sample()
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, fp string").repartition(4)
    got = simhash_groups(docs, leaf=leaf, block=block).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_every_near_pair_shares_a_leaf(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)) for _ in base], np.uint64)
    ball = np.uint64(12345) ^ np.array([sum(1 << int(b) for b in rng.choice(40, 4, replace=False)) for _ in range(300)], np.uint64)
    half = (np.uint64(77) << np.uint64(32)) | rng.integers(0, 2**32, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, near, ball, half]))
    leaves = vantage_shards(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), leaf=40).collect()
    shards = {}
    for shard, fp in leaves:
        shards.setdefault(int(np.int64(fp).view(np.uint64)), set()).add(shard)
    assert len({s for x in shards.values() for s in x}) > 20
    for i, x in enumerate(fps):
        for y in fps[i + 1 :][np.bitwise_count(x ^ fps[i + 1 :]) <= 3]:
            assert shards[int(x)] & shards[int(y)]


def test_spanning_links_connect_what_all_links_connect():
    rng = np.random.default_rng(6)
    for n in (1, 2, 70, 700):
        fps = np.unique(rng.integers(0, 2 ** (8 if n == 70 else 14), n, dtype=np.uint64) * np.uint64(0x0101_0001))
        a, b = spanning_links(fps)
        place = {int(x): k for k, x in enumerate(fps)}
        parent = list(range(len(fps)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for x, y in zip(a, b):
            assert (int(x) ^ int(y)).bit_count() <= 3
            parent[root(place[int(x)])] = root(place[int(y)])
        mine, all_ = [root(i) for i in range(len(fps))], components(fps.tolist())
        assert len(a) < max(2, len(fps)) and len(set(zip(mine, all_))) == len(set(mine)) == len(set(all_))


def test_query_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = LLM_QUERIES["op11_simhash_dedup"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_empty_table(spark, empty_sf):
    assert LLM_QUERIES["op11_simhash_dedup"](spark, empty_sf).count() == 0
