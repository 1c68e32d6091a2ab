"""SimHash near-dedup by vantage-point trees (operator 11).

*Fingerprints.*  Bit k of a document's 64-bit fingerprint is 1 if it is set in over half of the XXH64 hashes (seed 42)
of its 3-word shingles, repeats included.  Documents whose fingerprints differ in at most 3 bits are linked.

*Trees.*  Two linked fingerprints differ in at most one bit of the left or of the right half, so there is one
vantage-point tree for each half: it measures the Hamming distance there and has to find pairs within 1.  All distinct
fingerprints start in the root shard of both trees.  In each round a shard that is too large takes a vantage point
v and is cut into rings of distance from v.  By the triangle inequality distances of a pair differ by at most the
radius, so a ring also takes the members that lie that much above its upper edge, and each pair meets in a ring.  Where
the tree's own half doesn't spread (many fingerprints share it), the shard measures the other half, whose pairs lie
within 3.

*Leaves.*  A shard that is small, or that no vantage point cuts (a dense ball of fingerprints), is compared exactly.
There a breadth-first search visits each fingerprint once and returns the links of a spanning forest, never all pairs
of a group.  A ball of more than ``BLOCK`` fingerprints is dealt to pairs of blocks, so a task holds two blocks.

Fingerprints are unique in the trees: any number of copies is one entry.  The tables that name a vantage point or the
rings of each shard are plain join sides: Spark broadcasts them while their bytes are below its threshold and shuffles
beyond it.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import llm_query, stored
from flowlens.llm.jaccard_join import components

WORDS, SEED, BITS, NEAR = 3, 42, 64, 3
#: Entries that a leaf is compared at once, and of a block of a leaf that can't be cut.
LEAF, BLOCK = 4096, 16384
#: Shingles that are hashed at a time: the memory that a very long text takes.
CHUNK = 1 << 16
LEFT, RIGHT = -(1 << 32), (1 << 32) - 1
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    size = min(WORDS, len(words))
    shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(size)), strict=False))
    ones, n = np.zeros(BITS, np.int64), len(words) - size + 1
    while digests := b"".join([xxhash.xxh64_digest(s, SEED) for s in islice(shingles, CHUNK)]):
        ones += np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint of a whole text."""

    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py()) for t in texts], pa.int64())

    return fingerprints(text)


def _half(column: Column, left: Column | bool) -> Column:
    return F.when(F.lit(left) if isinstance(left, bool) else left, column.bitwiseAND(F.lit(LEFT))).otherwise(column.bitwiseAND(F.lit(RIGHT)))


def _rings(size: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Rings (first distance, last distance of its own) that cut a shard with ``size[d]`` members at distance d; none if
    that would not pay: rings overlap by ``radius``, and must hold at most 0.7 of the members each and twice all of them together."""
    n, edges, at = size.sum(), [0], 0
    for d in range(1, len(size)):
        at += size[d - 1]
        if at >= n / 8 and d - edges[-1] >= max(1, 2 * radius) and size[d:].sum() >= n / 16:
            edges.append(d)
            at = 0
    rings = [(a, b - 1) for a, b in zip(edges, [*edges[1:], len(size)], strict=True)]
    holds = [size[a : b + radius + 1].sum() for a, b in rings]
    return rings if len(rings) > 1 and max(holds) <= 0.7 * n and sum(holds) <= 2 * n else []


def _cuts(counts: pa.Table) -> pa.Table:
    """For one shard with counts by (own half or not, distance): v, whether the other half measures, and for each
    distance the rings that take it; no row if it can't be cut."""
    t = counts.to_pandas()
    best = None
    for other, radius in ((False, 1), (True, NEAR)):
        own = t[t["other"] == other]
        size = np.zeros(33, np.int64)
        size[own["d"].to_numpy()] = own["n"].to_numpy()
        rings = _rings(size, radius)
        if rings:
            cost = sum(float(size[a : b + radius + 1].sum()) ** 2 for a, b in rings)
            if best is None or cost < best[0]:
                best = (cost, other, [[k for k, (a, b) in enumerate(rings) if a <= d <= b + radius] for d in range(33)])
    if best is None:
        return pa.table({"shard": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "other": pa.array([], pa.bool_()), "rings": pa.array([], pa.list_(pa.list_(pa.int32())))})
    return pa.table({"shard": pa.array(t["shard"][:1], pa.int64()), "v": pa.array(t["v"][:1], pa.int64()), "other": pa.array([best[1]], pa.bool_()), "rings": pa.array([best[2]], pa.list_(pa.list_(pa.int32())))})


def vantage_shards(prints: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(shard, fp): leaves of both trees over ``prints`` (fp, distinct).  Fingerprints within 3 bits share a leaf.

    A round cuts every shard above ``leaf`` once; it ends when none can be cut.  A shard's name is a hash of its
    path; a clash would only put two shards together.
    """
    roots = F.explode(F.array(F.lit(True), F.lit(False))).alias("left")
    open_ = stored(prints.select("fp", roots).select(F.when(F.col("left"), F.lit(1)).otherwise(F.lit(2)).cast("long").alias("shard"), "left", "fp"), "vantage-entries")
    done, turn = [], 0
    while True:
        large = open_.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(turn))).alias("v")).where(F.col("n") > leaf)
        large = stored(large, "vantage-points")
        if large.isEmpty():
            done.append(open_)
            break
        seen = open_.join(large.select("shard", "v"), "shard")
        apart = F.col("fp").bitwiseXOR(F.col("v"))
        far = [F.struct(F.lit(o).alias("other"), F.bit_count(_half(apart, F.col("left") if not o else ~F.col("left"))).alias("d")) for o in (False, True)]
        counts = seen.select("shard", "v", F.explode(F.array(*far)).alias("m")).groupBy("shard", "v", "m.other", "m.d").agg(F.count(F.lit(1)).alias("n"))
        cuts = stored(counts.groupBy("shard").applyInArrow(_cuts, "shard bigint, v bigint, other boolean, rings array<array<int>>"), "vantage-cuts")
        marked = open_.join(cuts, "shard", "left")
        done.append(marked.where("v IS NULL").select("shard", "left", "fp"))
        measured = F.bit_count(_half(F.col("fp").bitwiseXOR(F.col("v")), F.col("left") != F.col("other")))
        inner = marked.where("v IS NOT NULL").select("shard", "left", "fp", "v", F.explode(F.get(F.col("rings"), measured)).alias("ring"))
        if cuts.isEmpty():
            break
        open_ = stored(inner.select(F.xxhash64("shard", "v", "ring").alias("shard"), "left", "fp"), "vantage-entries")
        turn += 1
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.unionByName(more)
    return leaves.select("shard", "fp")


def spanning_links(fps: np.ndarray, near: int = NEAR, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) that connect exactly what all links among ``fps`` (distinct) connect; at most one for each fingerprint."""
    fps = fps.astype(np.uint64)
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    waiting = fps
    while len(waiting):
        roots, waiting = waiting[:step], waiting[step:]
        alone = np.bitwise_count(roots[:, None] ^ np.concatenate([roots, waiting])[None, :]) <= near
        linked = alone.sum(1) > 1
        waiting = np.concatenate([roots[linked], waiting]) if linked.any() else waiting
        for _ in range(int(linked.sum())):
            if not len(waiting):
                break
            front, waiting = waiting[:1], waiting[1:]
            while len(front) and len(waiting):
                found = []
                for x in front:
                    hit = np.bitwise_count(x ^ waiting) <= near
                    if hit.any():
                        y, waiting = waiting[hit], waiting[~hit]
                        left.append(np.full(len(y), x))
                        right.append(y)
                        found.append(y)
                        if not len(waiting):
                            break
                front = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def leaf_links(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links of a spanning forest of each leaf; a leaf above ``block`` is dealt to pairs of blocks."""
    sizes = stored(leaves.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "leaf-sizes").where(F.col("n") > block)
    counted = leaves.join(sizes, "shard", "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    with_others = counted.withColumn("own", own).select("shard", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = with_others.select("shard", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "fp")

    def search(group: pa.Table) -> pa.Table:
        x, y = spanning_links(np.unique(group.column("fp").to_numpy()).astype(np.int64).view(np.uint64))
        return pa.table({"a": pa.array(x.view(np.int64)), "b": pa.array(y.view(np.int64))})

    return dealt.groupBy("shard", "i", "j").applyInArrow(search, "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id_col, fingerprint (16 lowercase hex digits), component_id, the smallest id reachable by links.

    Null and empty texts have fingerprint 0, linked like any other; texts of any length are read whole.  Repeated
    rows and rows that share an id each have a row.  A null id is not the smallest of anything: its row has the smallest
    other id of its component, or null.  Other columns are not read, so their names don't matter; an empty table gives none.
    """
    found = stored(docs.select(F.col(id_col).alias("_doc"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    prints = stored(found.groupBy("fp").agg(F.min("_doc").alias("rep")), "distinct-fingerprints")
    links = leaf_links(vantage_shards(prints.select("fp"), leaf), block)
    comps = components(links)
    of = prints.join(comps.select(F.col("cls").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    smallest = of.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = stored(of.join(smallest, "comp").select("fp", "component_id"), "fingerprint-groups")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.join(named, "fp").select(F.col("_doc").alias(id_col), hexed, "component_id")


@llm_query("op11_simhash_dedup")
def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
