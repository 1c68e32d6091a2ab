"""Jaccard join against all pairs: groups of near copies, shared passages, copies, odd texts."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from flowlens.llm.jaccard_join import LEAF, cut_cells, keep_one_of_each, linked, similar_groups, spanning_links


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets, comp = [shingles(t) for _, t in rows], [i for i, _ in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != comp[b]
            comp[a] = comp[b] = low
    return sorted((rows[k][0], len(sets[k]), comp[k]) for k in range(len(rows)))


def sample():
    rng, rows = random.Random(3), []
    passage = [f"p{k}" for k in range(60)]
    for n in (5, 30, 75, 130, 400):  # near copies
        base = [f"w{rng.randint(0, 400)}" for _ in range(n)]
        for _ in range(24):
            x = list(base)
            for _ in range(rng.randint(0, 1 + n // 40)):
                x[rng.randrange(n)] = f"z{rng.randint(0, 3)}"
            rows.append(" ".join(x))
    for k in range(60):  # a shared passage with a tail of its own
        rows.append(" ".join(passage + [f"t{k}x{j}" for j in range(k % 30)]))
    rows += [None, "", " ", "A b", "a  B", "one two three four five", "ONE two\nthree four five", "É b c d e", "é b c d e"] + ["copy of a text that stays the same"] * 20
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows))


@pytest.mark.parametrize(("few", "leaf"), [(3, 600), (3, 5000), (16, LEAF)])
def test_groups_equal_all_pairs(spark, few, leaf):
    """A small ``leaf`` makes regions recurse and dense ones be searched by pairs of blocks."""
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = similar_groups(docs, few=few, leaf=leaf).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_groups_are_the_same_without_broadcasts(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, similar_groups(docs, few=3).collect()))
        kept = sorted(r["doc_id"] for r in keep_one_of_each(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute(rows)
    assert kept == sorted({r[2] for r in brute(rows)})


def test_spanning_links_connect_what_all_links_connect():
    rng = random.Random(7)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(3)] + list(range(k % 5 * 100, k % 5 * 100 + 40)), np.uint64)) for k in range(60)]
    sets += [np.unique(np.array(rng.sample(range(500, 560), 50), np.uint64)) for _ in range(60)]
    comps = np.array([k // 2 * 2 for k in range(120)])
    parent = {int(c): int(c) for c in comps}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for i, j in combinations(range(120), 2):
        if linked(sets[i], sets[j]):
            parent[root(int(comps[i]))] = root(int(comps[j]))
    want = {frozenset(k for k in range(120) if root(int(comps[k])) == r) for r in {root(int(c)) for c in comps}}
    found = spanning_links(sets, comps)
    parent = {int(c): int(c) for c in comps}
    for i, j in found:
        assert linked(sets[i], sets[j]) and root(int(comps[i])) != root(int(comps[j]))
        parent[root(int(comps[i]))] = root(int(comps[j]))
    assert {frozenset(k for k in range(120) if root(int(comps[k])) == r) for r in {root(int(c)) for c in comps}} == want


def test_cuts_keep_near_members_together(spark):
    """Of one heavy cell, members whose distances to the pivot differ by at most EPS share a part."""
    rng = random.Random(1)
    bins = [rng.choice([0, 3, 12, 20, 21, 30, 31, 32, 44, 50]) for _ in range(60)]
    heavy = spark.createDataFrame([(7, x, 10, 600, 0) for x in range(60)], "cell long, x long, n long, weight long, p long")
    tested = spark.createDataFrame([(0, x, 50 - b, 50) for x, b in enumerate(bins) if x], "a long, b long, same long, total long")
    parts, whole = cut_cells(heavy, tested)
    assert whole.count() == 0
    of = {}
    for r in parts.collect():
        of.setdefault(r["x"], set()).add(r["cell"])
    bins[0] = 0
    assert len(of) == 60 and all(of[x] & of[y] for x in of for y in of if abs(bins[x] - bins[y]) <= 10)
    assert max(sum(c in v for v in of.values()) for c in set().union(*of.values())) <= 45
    same = spark.createDataFrame([(0, x, 30, 50) for x in range(1, 60)], "a long, b long, same long, total long")
    parts, whole = cut_cells(heavy, same)
    assert parts.count() == 0 and whole.count() == 60


def test_columns_named_like_the_operators_own(spark):
    names = ["row", "id", "stay", "first", "n", "_rows", "_cls", "cls", "_stay", "_doc", "_text", "component_id"]
    docs = spark.createDataFrame([(k, f"a b c d e f g {k // 2}", *[f"{c}{k}" for c in names]) for k in range(4)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(k, f"a b c d e f g {k // 2}", *[f"{c}{k}" for c in names]) for k in (0, 2)]


def test_a_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    docs = spark.createDataFrame([(3, long), (1, long + " end"), (2, "start " + long[: len(long) // 2])], "doc_id long, text string")
    assert sorted(tuple(r) for r in similar_groups(docs).collect())[0][2] == 1
    assert {r["doc_id"]: r["component_id"] for r in similar_groups(docs).collect()} == {1: 1, 3: 1, 2: 2}


def test_one_document_of_each_group_stays(spark):
    rows = [(9, "a b c d e f g", "x"), (4, "A b c d e f g", "y"), (7, None, "z"), (8, "other words", "w")]
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"]) for r in kept) == [(4, "y"), (7, "z"), (8, "w")]


def test_shared_and_null_ids_leave_one_row_of_each_group(spark):
    def words(name, last):
        return " ".join([f"{name}{k}" for k in range(60)] + [last])

    rows = [(5, words("a", "x")), (5, words("b", "x")), (3, words("b", "y")), (None, words("c", "x")), (None, words("c", "y")), (None, words("d", "x")),
            (None, words("a", "y")), (6, words("e", "x")), (6, words("e", "y")), (7, None), (7, " ")]
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] or -1, (r["text"] or " ").split(" ")[0]) for r in kept)
    assert got == [(-1, "c0"), (-1, "d0"), (3, "b0"), (5, "a0"), (6, "e0"), (7, ""), (7, "")]
