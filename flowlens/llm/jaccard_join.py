"""Exact n-gram Jaccard join in metric space (operator 8).

Distance is 1 - Jaccard of the 5-word shingle sets; documents within EPS = 0.2 are linked.

*Level 1, shingle pivots.*  Against any few documents nearly every document has distance 1, and
windows would replicate everything.  The first pivots are therefore single shingles: a document
lies at 1 - 1/n from each of its n shingles and at 1 from all others, so its regions are its own
shingles.  A document within EPS of x lacks at most n/5 of x's shingles; the *window* of x is all
its shingles in a fixed part of the hash space (all of them if x is short), and a partner is in at least
|window| - n/5 of the same regions.  Regions of up to ``FEW`` documents give their pairs, counted;
larger ones only tell their documents how many of their regions are large.  A document with fewer
large regions than that bound meets each partner in a small region, at least as often as the bound
exceeds the large ones.

*Level 2.*  Documents for which the bound proves nothing join among themselves, over all their shingles.

*Document pivots.*  What is left are documents made of shingles that many others have: tight
groups, where distances tell something.  Linked ones share one of their n/5 + 1 rarest shingles, and all documents
that share such a shingle join the region of one of them, its pivot, so a pair meets in a region and most
documents are in few.  A region that is too heavy for one task and not one component yet takes a
new pivot by hash; its members get their exact distance, those within EPS are linked to it, and the region
is cut at a distance r into an inner part, up to r + EPS, and an outer one, beyond r.  By the triangle inequality a pair
meets in one of them.  Parts recurse with pivots of their own until they are one component, light, or no cut makes them
lighter.

*Leaves.*  A light region is searched by one task, a heavy one that can't be cut by pairs of blocks.  Sets of different
components are compared if their sizes and 512 parities, whose distance is never above that of the sets,
allow a link; a link joins two components at once, so what a leaf returns is a spanning forest, never all
pairs.

All pairs are verified on whole sets.  Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.common import first_rows, lean, llm_query, partitions, slices, stored, tidied, whole_rows
from flowlens.llm.words import Words, grams

WORDS = 5
FEW = 16
#: The window: this part of the hash space, and all of it for sets of up to SHORT shingles.
PART, SHORT = 0.4, 100
#: A document of up to this many shingles has partners of up to SHORT only.
SURELY_SHORT = SHORT * 4 // 5
ENTRIES_PER_BUCKET = 250_000
#: Shingles that a leaf holds: the weight of a region that one task searches, and of a block of a heavier one.
LEAF = 1_000_000
#: Distances to a pivot are told apart by fiftieths; EPS is ten of them.
BINS, REACH = 50, 10


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a whole text's 5-word shingles, A-Z lower-cased; a text of 1 to 4 words is one shingle,
    a null text or one without words has none."""
    w = Words((text or "").encode(), lower=True)
    return np.unique(grams(w.hash, min(WORDS, w.n))) if w.n else np.zeros(0, np.uint64)


def set_id(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit identifiers of a set: its class, and a check on it."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def window(s: np.ndarray, whole: bool) -> np.ndarray:
    return s if whole or len(s) <= SHORT else s[: np.searchsorted(s, np.uint64(int(PART * 2**64)))]


def region_keys(s: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of hashes: regions are named by these, so a few hold two shingles, which only adds candidates."""
    return np.unique(s >> np.uint64(64 - bits))


def provable(s: np.ndarray, whole: bool, bits: int) -> int:
    """Regions that a document surely shares with each partner, large regions included."""
    sure = s if whole or len(s) <= SURELY_SHORT else s[: np.searchsorted(s, np.uint64(int(PART * 2**64)))]
    return len(region_keys(sure, bits)) - len(s) // 5


def binary(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def class_table(docs: DataFrame, seed: int, bits: int) -> DataFrame:
    """_doc, n_shingles, cls, chk, sure, sure2: one row per document; cls is null for empty sets."""
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            out = []
            for t in batch.column(1):
                s = shingle_set(t.as_py())
                out.append((len(s), *(set_id(s, seed) if len(s) else (None, None)), provable(s, False, bits), provable(s, True, bits)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["_doc", "n_shingles", "cls", "chk", "sure", "sure2"])

    kind = docs.schema["_doc"].dataType.simpleString()
    return docs.mapInArrow(rows, f"_doc {kind}, n_shingles bigint, cls bigint, chk bigint, sure bigint, sure2 bigint")


def map_regions(texts: DataFrame, seed: int, bits: int, buckets: int, whole: bool, few: int) -> DataFrame:
    """(bucket, regions, classes, full, times): the (region, class) entries of a batch, dealt to buckets by region.

    Copies within a batch count once.  A region with more than ``few`` classes in the batch is large for
    sure: few + 1 of its entries prove that to its bucket, and the other classes are told at once
    (full, times), so a shingle that a third of all documents have doesn't fill its bucket.
    """
    @lean
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2500):
            sets = {}
            for t in batch.column(0):
                s = shingle_set(t.as_py())
                if len(s):
                    sets[set_id(s, seed)[0]] = region_keys(window(s, whole), bits)
            if not sets:
                continue
            keys = np.concatenate(list(sets.values()))
            cls = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(k) for k in sets.values()])
            order = np.argsort(keys, kind="stable")
            keys, cls = keys[order], cls[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            place = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
            full, times = np.unique(cls[place > few], return_counts=True)
            keys, cls = keys[place <= few], cls[place <= few]
            to, home = (keys % np.uint64(buckets)).astype(np.int64), full % buckets
            order = np.argsort(to, kind="stable")
            keys, cls, to = (keys // np.uint64(buckets))[order], cls[order], to[order]
            out = []
            for b in np.unique(np.concatenate([to, home])):
                i, j = np.searchsorted(to, [b, b + 1])
                out.append((int(b), binary(keys[i:j], "<u4"), binary(cls[i:j], "<i8"), binary(full[home == b], "<i8"), binary(times[home == b], "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "regions", "classes", "full", "times"])

    return texts.select("_text").mapInArrow(entries, "bucket int, regions binary, classes binary, full binary, times binary")


def pairs_of_regions(keys: np.ndarray, cls: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of the small regions (smaller class, larger class), and the classes of the large ones, each as often as it occurs."""
    order = np.lexsort((cls, keys))
    keys, cls = keys[order], cls[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])
    keys, cls = keys[new], cls[new]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    size = np.diff(np.append(first, len(keys)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in range(2, few + 1):
        at = first[size == g]
        for i in range(g if len(at) else 0):
            for j in range(i + 1, g):
                left.append(cls[at + i])
                right.append(cls[at + j])
    return np.concatenate(left), np.concatenate(right), *np.unique(cls[np.repeat(size > few, size)], return_counts=True)


def region_pairs(mapped: DataFrame, few: int) -> DataFrame:
    """(a, b, n): classes a < b that meet in n small regions; b is null for a class that is in n large ones."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    @lean
    def join(table: pa.Table) -> pa.Table:
        keys, cls, full, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("regions", "<u4"), ("classes", "<i8"), ("full", "<i8"), ("times", "<i4")))
        a, b, large, n = pairs_of_regions(keys, cls, few)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, int)
        met = np.diff(np.append(first, len(a)))
        empty = np.ones(len(large) + len(full), bool)
        return pa.Table.from_arrays([
            pa.array(np.concatenate([a[first], large, full])),
            pa.concat_arrays([pa.array(b[first]), pa.array(np.zeros(len(empty), np.int64), mask=empty)]),
            pa.array(np.concatenate([met, n, times]).astype(np.int64))], schema=schema)

    return mapped.groupBy("bucket").applyInArrow(join, "a bigint, b bigint, n bigint")


def level(texts: DataFrame, classes: DataFrame, seed: int, bits: int, buckets: int, whole: bool, few: int) -> tuple[DataFrame, DataFrame]:
    """One join by shingle regions: candidate pairs (a, b, met) of unlike classes, and the classes left over.

    ``classes`` has cls, n and sure.  A pair is dropped if its sizes are too unlike, or if it met
    less often than one of its classes must meet any partner.
    """
    met = stored(region_pairs(map_regions(texts, seed, bits, buckets, whole, few), few), "region-pairs")
    large = met.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("large"))
    least = stored(classes.join(large, "cls", "left").select("cls", "n", (F.col("sure") - F.coalesce(F.col("large"), F.lit(0))).alias("least")), "region-bounds")
    pairs = met.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("met"))
    for side in ("a", "b"):
        pairs = pairs.join(least.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("least").alias(f"least{side}")), side)
    pairs = pairs.where(alike("na", "nb") & (F.col("met") >= F.greatest("leasta", "leastb")))
    return stored(pairs.select("a", "b", "met"), "candidates"), stored(least.where("least < 1").select("cls", "n"), "left-over")


def alike(na: str, nb: str) -> Column:
    """Whether sets of these sizes can have a Jaccard similarity of 0.8."""
    return (100 * F.least(na, nb)) >= 80 * F.greatest(na, nb)


def texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """_text of the representatives ``reps`` (cls, rep): rows of ``docs`` whose id is one.  Rows that repeat an id come
    along; their classes are sorted out by the caller."""
    ids = stored(reps.select(F.col("rep").alias("_rep")).distinct(), "rep-ids")
    return docs.join(ids, F.col("_doc").eqNullSafe(F.col("_rep")), "left_semi")


def sets_of(docs: DataFrame, reps: DataFrame, seed: int) -> DataFrame:
    """(cls, shingles): whole sets of the classes in ``reps``, once each, as sorted unsigned 64-bit integers."""
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            sets = [s for s in (shingle_set(t.as_py()) for t in batch.column(0)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s, seed)[0] for s in sets], pa.int64()), pa.array([binary(s, "<u8") for s in sets], pa.binary())], ["cls", "shingles"])

    found = texts_of(docs, reps).select("_text").mapInArrow(rows, "cls bigint, shingles binary")
    return found.join(reps.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, same, total): exact sizes of intersection and union.  Both joins are plain shuffles, so a pivot that many
    pairs have can be split."""
    both = pairs.select("a", "b")
    for side in ("a", "b"):
        both = both.join(sets.select(F.col("cls").alias(side), F.col("shingles").alias(f"s{side}")), side)

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, total = [], []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_py(), "<u8") for c in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                i = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                same.append(i)
                total.append(len(x) + len(y) - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "same", "total"])

    return both.select("a", "b", "sa", "sb").mapInArrow(rows, "a bigint, b bigint, same bigint, total bigint")


LINKED = "100 * same >= 80 * total"


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): each class in ``links`` (a, b) and one class that stands for all that are reachable from it.

    Every class takes the name among its neighbours' and its own that comes first in an order that each round
    draws anew by hash; links are renamed and dropped when both ends agree.  So what is left shrinks by a
    constant factor from round to round, even for long chains; the renamings are composed from the last one
    back, small ones first.
    """
    edges, steps = stored(links.select("a", "b").where("a <> b").distinct(), "edges"), []
    while not edges.isEmpty():
        turn = F.lit(len(steps))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("cls")).agg(F.min_by("b", F.xxhash64("b", turn)).alias("near"))
        smaller = F.xxhash64("near", turn) < F.xxhash64("cls", turn)
        steps.append(stored(near.select("cls", F.when(smaller, F.col("near")).otherwise(F.col("cls")).alias("comp")), "renamed"))
        left, right = (steps[-1].select(F.col("cls").alias(s), F.col("comp").alias(f"c{s}")) for s in "ab")
        edges = stored(edges.join(left, "a").join(right, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("cls"), F.col("b").alias("comp"))
    out = steps.pop()
    while steps:
        then = out.select(F.col("cls").alias("comp"), F.col("comp").alias("_to"))
        out = steps.pop().join(then, "comp", "left").select("cls", F.coalesce("_to", "comp").alias("comp"))
    return stored(out, "renamed")


def with_comp(table: DataFrame, comps: DataFrame, cls: str, comp: str) -> DataFrame:
    """``table`` with the component of its column ``cls``; a class without links is its own."""
    of = comps.select(F.col("cls").alias(cls), F.col("comp").alias("_c"))
    return table.join(of, cls, "left").withColumn(comp, F.coalesce("_c", cls)).drop("_c")


def connected(comps: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """``comps`` after more links, and whether these connected anything.  Only components are linked anew."""
    between = with_comp(with_comp(links.select("a", "b"), comps, "a", "ca"), comps, "b", "cb").where("ca <> cb")
    renamed = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if renamed.isEmpty():
        return comps, False
    to = renamed.select(F.col("cls").alias("comp"), F.col("comp").alias("_to"))
    old = comps.join(to, "comp", "left").select("cls", F.coalesce("_to", "comp").alias("comp"))
    new = renamed.join(comps.select("cls"), "cls", "left_anti").select("cls", "comp")
    return stored(old.unionByName(new), "components"), True


def linked_components(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Components by all links among ``pairs`` (a, b, met).

    Each class is first compared with the partner that it met most often; of the other pairs only those
    are compared whose classes are not connected yet.
    """
    best = stored(pairs.groupBy("b").agg(F.max_by("a", F.struct("met", "a")).alias("a")), "best-pairs")
    comps = components(verified(best, sets).where(LINKED))
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    rest = with_comp(with_comp(rest, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb")
    return connected(comps, verified(rest, sets).where(LINKED))[0]


def regions_of(sets: DataFrame) -> DataFrame:
    """(region, x, n, i): the first n/5 + 1 shingles of each set, the rarest among ``sets`` first, each with its place i.

    Linked sets share one of these.  Shingles of one set only count as places and give no region.
    """
    @lean
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(s.as_py(), "<i8") for s in batch.column(1)]
            lengths = np.array([len(s) for s in found], np.int64)
            own = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lengths).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(own), pa.array(np.repeat(lengths, lengths))], ["region", "x", "n"])

    cells = stored(sets.mapInArrow(shingles, "region bigint, x bigint, n bigint"), "dense-shingles")
    count = stored(cells.groupBy(F.col("region").alias("_r")).agg(F.count(F.lit(1)).alias("df")), "dense-counts")
    place = F.row_number().over(Window.partitionBy("x").orderBy("df", "region")) - 1
    ranked = cells.join(count, F.col("region") == F.col("_r")).withColumn("i", place)
    return stored(ranked.where("i <= floor(n / 5) AND df > 1").select("region", "x", "n", F.col("i").cast("long").alias("i")), "pivot-regions")


PARITY = 8


def parity(s: np.ndarray) -> np.ndarray:
    """Of each of 512 classes of shingles, whether a set has an odd number: 8 integers.  Two sets differ in at least as
    many shingles as these differ in bits."""
    odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * same >= 80 * (len(x) + len(y) - same)


def spanning_links(sets: list[np.ndarray], comps: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that connect the components ``comps`` of ``sets`` as all links among them would, one less than what they
    connect.

    Components are taken from the smallest on, and their sets compared with those of components that are still apart;
    the largest one never searches.
    """
    size = np.array([len(s) for s in sets], np.int64)
    bits = np.array([parity(s) for s in sets], np.uint64).reshape(-1, PARITY)
    _, comp, members = np.unique(comps, return_inverse=True, return_counts=True)
    root, out = comp.copy(), []
    for c in np.lexsort((np.arange(len(members)), members))[:-1]:
        for i in np.flatnonzero(comp == c):
            near = np.flatnonzero((root != root[i]) & (100 * np.minimum(size, size[i]) >= 80 * np.maximum(size, size[i])))
            near = near[9 * np.bitwise_count(bits[near] ^ bits[i]).sum(1, dtype=np.int64) <= size[near] + size[i]]
            for j in near.tolist():
                if root[j] != root[i] and linked(sets[i], sets[j]):
                    out.append((int(i), j))
                    root[root == root[j]] = root[i]
    return out


def pivot_regions(sets: DataFrame) -> DataFrame:
    """(cell, x, n): the regions of the first document pivots.  All that share a shingle of their rarest join the region of the
    one among them that comes first by hash."""
    cells = regions_of(sets)
    pivots = stored(cells.groupBy(F.col("region").alias("_r")).agg(F.min_by("x", F.xxhash64("x")).alias("cell")), "first-pivots")
    return cells.join(pivots, F.col("region") == F.col("_r")).select("cell", "x", "n").distinct()


def pivot_components(sets: DataFrame, dense: DataFrame, comps: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``comps`` after all links among the classes of ``dense`` (cls), found by document pivots; ``leaf`` bounds the shingles that one
    task searches and changes the work, not the result."""
    sets = stored(sets.join(dense.select("cls"), "cls", "left_semi").select("cls", "shingles"), "pivot-sets")
    if sets.isEmpty():
        return comps
    cells, leaves, tested, turn = stored(pivot_regions(sets), "pivot-cells"), [], None, 0
    while True:
        here = stored(with_comp(cells, comps, "x", "comp"), "cell-members")
        facts = here.groupBy(F.col("cell").alias("_cell")).agg(F.sum("n").alias("weight"), F.min_by("x", F.xxhash64("x", F.lit(turn))).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        facts = stored(facts.where("lo <> hi").select("_cell", "weight", "p"), "cell-pivots")  # one component: done
        apart = here.join(facts, F.col("cell") == F.col("_cell"))
        leaves.append(apart.where(F.col("weight") <= leaf).select("cell", "x", "n"))
        heavy = stored(apart.where(F.col("weight") > leaf).select("cell", "x", "n", "weight", "p"), "heavy-members")
        if heavy.isEmpty():
            break
        pairs = heavy.where("x <> p").select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).distinct()
        found = stored(verified(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), sets), "pivot-distances")
        tested = found if tested is None else stored(tested.unionByName(found), "pivot-distances")
        comps, _ = connected(comps, found.where(LINKED))
        cells, whole = cut_cells(heavy, tested)
        leaves.append(whole)
        turn += 1
    entries = leaves[0]
    for more in leaves[1:]:
        entries = entries.unionByName(more)
    return connected(comps, leaf_links(stored(entries, "leaf-members"), comps, sets, leaf))[0]


def cut_cells(heavy: DataFrame, tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parts of the cells that a distance to their pivot cuts, and the cells that none does: a cut must leave no part
    above three quarters of the cell's weight."""
    either = tested.select("a", "b", F.expr(f"({BINS} * (total - same)) div total").alias("bin"))
    either = either.unionByName(either.select(F.col("b").alias("a"), F.col("a").alias("b"), "bin")).select(F.col("a").alias("_x"), F.col("b").alias("_p"), "bin")
    far = heavy.join(either, (F.col("x") == F.col("_x")) & (F.col("p") == F.col("_p")), "left").select("cell", "x", "n", "weight", "p", F.coalesce("bin", F.lit(0)).alias("bin"))
    far = stored(far, "cell-distances")
    sums = far.groupBy("cell", "weight", "bin").agg(F.sum("n").alias("w"))  # at most BINS + 1 rows a cell
    upto = Window.partitionBy("cell").orderBy("bin")
    sums = sums.select("cell", "weight", "bin", F.sum("w").over(upto.rangeBetween(Window.unboundedPreceding, REACH)).alias("inner"), F.sum("w").over(upto.rangeBetween(1, Window.unboundedFollowing)).alias("outer"))
    cuts = sums.where("outer IS NOT NULL").withColumn("most", F.greatest("inner", "outer")).groupBy(F.col("cell").alias("_cell")).agg(F.min_by("bin", F.struct("most", "bin")).alias("r"), F.min("most").alias("most"), F.max("weight").alias("_weight"))
    cuts = stored(cuts.where("4 * most <= 3 * _weight").select("_cell", "r"), "cell-cuts")
    marked = far.join(cuts, F.col("cell") == F.col("_cell"), "left")
    sides = F.array_compact(F.array(F.when(F.col("bin") <= F.col("r") + REACH, F.lit(0)), F.when(F.col("bin") > F.col("r"), F.lit(1))))
    parts = marked.where("r IS NOT NULL").select("cell", "p", "x", "n", F.explode(sides).alias("side"))
    return stored(parts.select(F.xxhash64("cell", "p", "side").alias("cell"), "x", "n"), "pivot-cells"), stored(marked.where("r IS NULL").select("cell", "x", "n"), "whole-cells")


def leaf_links(entries: DataFrame, comps: DataFrame, sets: DataFrame, leaf: int) -> DataFrame:
    """(a, b): links that connect the components of each leaf (cell, x, n); heavy ones are dealt to pairs of blocks."""
    here = with_comp(entries, comps, "x", "comp")
    facts = stored(here.groupBy(F.col("cell").alias("_cell")).agg(F.sum("n").alias("weight"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi"), "leaf-weights")
    blocks = F.ceil(F.col("weight") / F.lit(leaf)).cast("int")
    dealt = here.join(facts.select("_cell", blocks.alias("blocks")), F.col("cell") == F.col("_cell")).withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    dealt = dealt.select("cell", "x", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("cell", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "x", "comp").distinct()

    @lean
    def search(group: pa.Table) -> pa.Table:
        x = group.column("x").to_numpy()
        found = spanning_links([np.frombuffer(s.as_py(), "<u8") for s in group.column("shingles")], group.column("comp").to_numpy())
        return pa.table({"a": pa.array([x[i] for i, _ in found], pa.int64()), "b": pa.array([x[j] for _, j in found], pa.int64())})

    with_sets = dealt.join(sets.select(F.col("cls").alias("x"), "shingles"), "x")
    return with_sets.groupBy("cell", "i", "j").applyInArrow(search, "a bigint, b bigint").distinct()


@tidied
def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", few: int = FEW, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id.

    component_id is the smallest id reachable by links, the document itself included.  Documents
    with equal sets are linked; null texts and texts without words have no shingles and no links.
    Rows that repeat an id belong together only if their sets do, and a null id counts as no id: its
    row has the smallest other id of its component, or null.  Very long texts are read whole; an empty table gives no
    rows; other columns are not read.
    """
    members, final, _ = grouped(docs, id_col, text, few, leaf)
    return _members_ids(members, final).select(F.col("_doc").alias(id_col), "n_shingles", "component_id")


def _members_ids(members: DataFrame, final: DataFrame) -> DataFrame:
    """``members`` with component_id; a row without shingles has its own id."""
    out = members.withColumn("_key", F.coalesce("cls", F.xxhash64("_doc"))).join(final.select(F.col("cls").alias("_key"), "component_id"), "_key", "left")
    return out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("_doc")).otherwise(F.col("component_id")))


def grouped(docs: DataFrame, id_col: str, text: str, few: int = FEW, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, int]:
    """The rows (_doc, n_shingles, cls), the components of classes (cls, comp, component_id), and the seed of the classes."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text"))
    size = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(256, partitions(spark), int(size * PART / 6) // ENTRIES_PER_BUCKET)
    bits = min(63, 31 + buckets.bit_length())
    for seed in range(100):
        members = stored(class_table(source, seed, bits), "shingle-classes")
        grouped = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("_doc").alias("rep"), F.min("n_shingles").alias("n"), F.min("sure").alias("sure"), F.min("sure2").alias("sure2"), F.min("chk").alias("lo"), F.max("chk").alias("hi"))
        classes = stored(grouped, "classes")
        if classes.where("lo <> hi").isEmpty():
            break
    reps = classes.select("cls", "rep")
    pairs, left = level(source, classes, seed, bits, buckets, whole=False, few=few)
    rest = texts_of(source, left.join(reps, "cls"))
    again = left.join(classes.select("cls", F.col("sure2").alias("sure")), "cls")
    more, dense = level(rest, again, seed, bits, buckets, whole=True, few=few)
    pairs = stored(pairs.unionByName(more).groupBy("a", "b").agg(F.max("met").alias("met")), "candidates")
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(dense.select("cls")).distinct()
    sets = stored(sets_of(source, reps.join(wanted, "cls", "left_semi"), seed), "sets")
    comps = pivot_components(sets, dense, linked_components(pairs, sets), leaf)
    named = with_comp(reps, comps, "cls", "comp")
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = stored(named.join(smallest, "comp").select("cls", "comp", "component_id"), "class-ids")
    return members, final, seed


def class_of(text: Column, seed: int) -> Column:
    """The class of a text, null for an empty set."""

    @F.arrow_udf("bigint")
    def classes(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(t.as_py()) for t in texts)
        return pa.array([set_id(s, seed)[0] if len(s) else None for s in sets], pa.int64())

    return classes(text)


@tidied
def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns (whatever they are called), with one row of each group of linked ones: the one with the smallest
    id.  Rows without shingles have no links and stay.

    An id that occurs once is joined by itself.  Rows that share an id (or have none) are told apart by their class; if
    several of a group have its smallest id, the first by a digest of the whole row stays.
    """
    members, final, seed = grouped(docs, id_col, text)
    named = _members_ids(members, final).select(F.col("_doc").alias("stay"), F.col("_doc").eqNullSafe(F.col("component_id")).alias("first"))
    ids = named.groupBy("stay").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("any")).where("any").drop("any")
    ids = stored(ids, "stay")
    rows = whole_rows(docs, id=F.col(id_col)).join(ids, F.col("id").eqNullSafe(F.col("stay")))
    once = rows.where("n = 1").select("row.*")
    if ids.where("n > 1").isEmpty():
        return once
    shared = stored(rows.where("n > 1").select("row", "stay", class_of(F.col(f"row.{text}"), seed).alias("cls")), "shared-ids")
    comps = final.select(F.col("cls").alias("_cls"), F.col("comp").alias("_comp"), F.col("component_id").alias("_smallest"))
    linked_rows = shared.where("cls IS NOT NULL").join(comps, F.col("cls") == F.col("_cls")).where(F.col("stay").eqNullSafe(F.col("_smallest")))
    return once.unionByName(shared.where("cls IS NULL").select("row.*")).unionByName(first_rows(linked_rows, ["_comp"]).select("row.*"))


@llm_query("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
