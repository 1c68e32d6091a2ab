"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 3, built-in functions only).

Each source's documents stand on a word axis in a random (hash) order; its target is a prefix of
two passes over that axis, cut into blocks.  A tree splits the exact block quotas of all sources
among the output shards; each shard then draws its own disjoint blocks in a permuted order and
shuffles its documents locally: the mix is written shard by shard, each in the order of its places.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.common import llm_query, numbered, partitions, stored, tidied, whole_rows, word_count

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
#: A prime above every number of blocks: multiplying by it permutes the blocks of a source.
PRIME = (1 << 61) - 1
HASH_BITS = 62


def order_hash(seed: int, *parts) -> Column:
    """A hash in [0, 2^62)."""
    return F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def source_key(source: Column) -> Column:
    """A join key that is never null: '' for the null source, '=' and the name for the others."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size, _no: sources numbered by code point, null last, by range partitions (no single sort task)."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = stored(totals.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "source-sizes")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    first = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("_place", place).join(first, "_part").select("source", "source_size", (F.col("_first") + F.col("_place")).alias("_no"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE) -> DataFrame:
    """source, source_size, target, _no, _words (the target as whole words).

    All targets share ``share`` of all sizes by weight; a target stops at twice its source's size and
    the excess is shared again by weight among the others, until none is above.  Each round is one
    aggregate over the sources; the driver sees two sums.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_no") % len(weights)).cast("int") + 1)
    sources = stored(numbered_sources(sizes).withColumn("_weight", weight), "source-weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("_weight") * F.lit(float(level)) > 2 * F.col("source_size")
        row = sources.agg(F.sum(F.when(above, 2 * F.col("source_size"))).alias("full"), F.sum(F.when(~above, F.col("_weight"))).alias("free"), F.count_if(above).alias("n")).first()
        if row["n"] == stopped or not row["free"]:
            break
        stopped = row["n"]
        level = (share * total - (row["full"] or 0)) / row["free"]
    target = F.least(2.0 * F.col("source_size"), F.col("_weight") * F.lit(float(level or 0)))
    words = F.least(2 * F.col("source_size"), F.round(target).cast("long"))
    return sources.select("source", "source_size", target.alias("target"), "_no", words.alias("_words"))


def _drawn(node_counts: Column, slots: Column, total: Column, seed: int, *node: Column) -> Column:
    """Of a node's blocks by source, how many the left child gets: a multivariate-hypergeometric draw.

    Selection sampling over the counts: each block goes left with chance (places left) / (blocks
    left).  The chance bits are hashes, so a retry draws the same.
    """

    def one_source(acc, entry):
        def one_block(state, i):
            left = F.pmod(order_hash(seed, *node, entry["no"], i), state["blocks"]) < state["places"]
            return F.struct((state["places"] - left.cast("long")).alias("places"), (state["blocks"] - 1).alias("blocks"), (state["got"] + left.cast("long")).alias("got"))

        start = F.struct(acc["places"].alias("places"), acc["blocks"].alias("blocks"), F.lit(0).cast("long").alias("got"))
        end = F.aggregate(F.sequence(F.lit(1).cast("long"), entry["n"]), start, one_block)
        return F.struct(end["places"].alias("places"), end["blocks"].alias("blocks"), F.concat(acc["drawn"], F.array(end["got"])).alias("drawn"))

    empty = F.struct(slots.alias("places"), total.alias("blocks"), F.array().cast("array<bigint>").alias("drawn"))
    return F.aggregate(node_counts, empty, one_source)["drawn"]


def shard_quotas(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, no, n: blocks of each source in each shard.  ``blocks`` has no and n (above 0) of each source.

    The root holds every source's count; a node halves its shards and its blocks until one shard is
    left.  ``shards`` is a power of two.  Shard j has floor(N (j + 1) / shards) - floor(N j / shards) blocks.
    Counts are kept sparse, so the tree's rows grow with sources and blocks, not with their product.
    """
    root = F.array_sort(F.collect_list(F.struct("no", "n"))).alias("counts")
    nodes = blocks.agg(root, F.coalesce(F.sum("n"), F.lit(0)).alias("all")).select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "counts", "all")

    def blocks_before(j: Column) -> Column:
        return F.floor(F.col("all") * j / F.lit(shards)).cast("long")

    for _ in range(shards.bit_length() - 1):
        nodes = nodes.withColumn("mid", F.shiftright(F.col("lo") + F.col("hi"), 1))
        places = blocks_before(F.col("mid")) - blocks_before(F.col("lo"))
        drawn = _drawn(F.col("counts"), places, blocks_before(F.col("hi")) - blocks_before(F.col("lo")), seed, F.col("lo"), F.col("hi"))
        nodes = stored(nodes.withColumn("left", drawn), "mix-tree")
        both = F.arrays_zip("counts", "left")
        lefts = F.transform(both, lambda z: F.struct(z["counts"]["no"].alias("no"), z["left"].alias("n")))
        rights = F.transform(both, lambda z: F.struct(z["counts"]["no"].alias("no"), (z["counts"]["n"] - z["left"]).alias("n")))
        halves = F.array(F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.filter(lefts, lambda e: e["n"] > 0).alias("counts")),
                         F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.filter(rights, lambda e: e["n"] > 0).alias("counts")))
        nodes = nodes.select("all", F.explode(halves).alias("h")).select("h.lo", "h.hi", "h.counts", "all")
    return nodes.select(F.col("lo").alias("shard"), F.inline("counts"))


@tidied
def mix_plan(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS,
             share: Fraction = SHARE, seed: int = 17, words_per_shard: int = 1_000_000, blocks_per_shard: int = 16, max_shards: int = 1 << 16) -> DataFrame:
    """One row per row of ``docs``: id_col, source, size, source_size, target, taken and the two draws first and second.

    A draw is a struct (words, shard, place): the words taken in that pass, the output shard, and a
    hash that orders the shard's documents; it is null if the pass does not take the document.
    A source's documents are taken whole, once or twice, until its target is met; only the last one
    is cut there, so the words taken are the target rounded to a whole word.  Documents without words
    are taken 0 words.  Rows that repeat an id and a size are interchangeable; equal hashes are ordered
    by id and size.  Null ids and sources are ids and sources like any other (the null source is last).

    Output shards hold about ``words_per_shard`` words; above ``max_shards`` they grow instead.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sizes = stored(narrow.withColumn("_hash", order_hash(seed, "_id", "size")), "sizes")
    targets = stored(source_targets(sizes, weights, share).withColumn("_key", source_key(F.col("source"))).drop("source"), "targets")
    wanted = targets.agg(F.sum("_words")).first()[0] or 0
    shards = 1 << min(max(0, -(-wanted // words_per_shard) - 1).bit_length(), max_shards.bit_length() - 1)
    block = max(1, -(-wanted // (shards * blocks_per_shard)))
    targets = targets.withColumn("_blocks", F.ceil(F.col("_words") / F.lit(block)).cast("long"))

    # a block's shard: the source's blocks, in permuted order, are dealt to its shards in turn
    quotas = stored(shard_quotas(targets.where("_blocks > 0").select(F.col("_no").alias("no"), F.col("_blocks").alias("n")), shards, seed), "quotas")
    until = F.sum("n").over(Window.partitionBy("no").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    slots = quotas.withColumn("_end", until).select("no", "shard", F.explode(F.sequence(F.col("_end") - F.col("n"), F.col("_end") - 1)).alias("slot"))
    slots = stored(slots, "slots")

    # word offsets: hash ranges cut every source alike, so no source is one task
    bits = max(1, (4 * partitions(spark) - 1).bit_length())
    docs_at = sizes.select("*", source_key(F.col("source")).alias("_key"), F.shiftright("_hash", HASH_BITS - bits).alias("_range"))
    ranges = docs_at.groupBy("_key", "_range").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").join(targets, "_key")
    ranges = stored(ranges, "ranges")
    inside = Window.partitionBy("_key", "_range").orderBy("_hash", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs_at.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["_key", "_range"])
    start = F.col("_first") + F.col("_inside")
    for n, at in ((1, start), (2, start + F.col("source_size"))):
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_words") - at))
        index = F.floor(at / F.lit(block)).cast("long")
        slot = F.pmod(index * F.pmod(F.lit(PRIME), F.col("_blocks")) + F.col("_no"), F.col("_blocks"))
        nowhere = -1 - F.pmod(F.col("_hash"), F.lit(1 << 16))  # untaken rows match nothing, and spread out
        placed = placed.withColumns({f"_words{n}": words, f"_slot{n}": F.when(words > 0, slot).otherwise(nowhere)})
    for n in (1, 2):
        of = slots.select(F.col("no").alias("_no"), F.col("slot").alias(f"_slot{n}"), F.col("shard").alias(f"_shard{n}"))
        placed = placed.join(of, ["_no", f"_slot{n}"], "left")

    def draw(n: int) -> Column:
        return F.when(F.col(f"_words{n}") > 0, F.struct(F.col(f"_words{n}").alias("words"), F.col(f"_shard{n}").alias("shard"), order_hash(seed + n, "_hash", "_id").alias("place")))

    return placed.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", (F.col("_words1") + F.col("_words2")).alias("taken"), draw(1).alias("first"), draw(2).alias("second"))


@tidied
def mix_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: ``docs``' rows, all columns (whatever they are called), once for each draw, dealt to the output
    shards of the draws and in the order of their places there: a shard is one partition's run of rows.

    Documents stay whole here: a draw counts if it takes at least half of its document, so a source's
    words differ from its target by at most half a document.  Documents without words are not in a mix.
    Rows that repeat an id and a size share their draws: of k such rows the i-th takes draws i and i + k.
    """
    drawn = mixed_rows(docs, id_col, **options)
    return drawn.repartition(partitions(docs.sparkSession), "shard").sortWithinPartitions("shard", "place").select("row.*")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(row, shard, place): a row of ``docs`` for each draw that counts."""
    plan = stored(mix_plan(docs, id_col, **options), "mix-plan").select(F.col(id_col).alias("of"), F.col("size").alias("of_size"), "first", "second")
    counts = F.filter(F.array("first", "second"), lambda d: d["words"] * 2 >= F.col("of_size"))
    draws = plan.select("of", "of_size", counts.alias("draws"))
    rows_of = stored(draws.groupBy("of", "of_size").agg(F.count(F.lit(1)).alias("k")), "mix-rows")
    text = options.get("text", "text")
    rows = whole_rows(docs, id=F.col(id_col), size=word_count(F.col(text)))

    def same(a: str, b: str) -> Column:
        return F.col("id").eqNullSafe(F.col(a)) & (F.col("size") == F.col(b))

    once = draws.join(rows_of.where("k = 1").select(F.col("of").alias("o"), F.col("of_size").alias("s")), F.col("of").eqNullSafe(F.col("o")) & (F.col("of_size") == F.col("s")), "left_semi")
    out = rows.join(once.where(F.size("draws") > 0), same("of", "of_size")).select("row", F.explode("draws").alias("d"))
    shared = rows_of.where("k > 1")
    if not shared.isEmpty():
        known = shared.withColumnsRenamed({"of": "o", "of_size": "s"})
        each = draws.join(known, F.col("of").eqNullSafe(F.col("o")) & (F.col("of_size") == F.col("s"))).select("of", "of_size", "k", F.explode("draws").alias("d"))
        each = numbered(each, ["of", "of_size"], [F.col("d.shard"), F.col("d.place"), F.col("d.words")], "j").withColumn("j", F.col("j") % F.col("k"))
        some = rows.join(known.select("o", "s"), same("o", "s"), "left_semi")
        some = numbered(some, ["id", "size"], [F.sha2(F.to_json("row"), 256)], "i")
        out = out.unionByName(some.join(each, same("of", "of_size") & (F.col("i") == F.col("j"))).select("row", "d"))
    return out.select("row", "d.shard", "d.place")


@llm_query("op3_source_mixing")
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("first", "second") for c in ("shard", "place")])
