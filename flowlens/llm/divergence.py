"""Audit of how sources diverge from each other and from their language, by chunk factorization (operator 12).

Terms hold no white space, so a text's terms are those of its white-space chunks, and a chunk's terms don't depend on the
text.

1. *Blocks.*  Documents are factored in blocks: a block lists each of its chunks once and, for each document, which
   chunks it has and how often.
2. *Chunks.*  The lists are dealt to buckets of chunks by hash; a bucket cuts each globally distinct chunk into terms
   once and sends the terms back to the blocks that list it.
3. *Counts.*  A block now knows the terms of its documents: it counts, for each (lang, source, term), in how many of its
   documents the term is and how often, and deals the counts to buckets of terms by hash.
4. *Terms.*  A bucket sums the blocks' counts and keeps the terms that are in enough documents of their lang.
5. *Divergence.*  With the totals of the kept terms known, a bucket is a matrix of shares (terms x sources of a lang) and
   returns its part of the sums over pairs of sources, and each source's top terms within the bucket.

A chunk or term that every document has is one entry a block, so none is hot, and what moves are lists of a block for a
bucket, as one row each.  Buckets and blocks are bounded.  All arithmetic is exact: integers beyond 64 bits are Python's.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.common import lean, llm_query, partitions, stored, tidied

#: What terms are made of.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: A block ends with the document that takes it to this many documents or bytes.
BLOCK_DOCS, BLOCK_BYTES = 4000, 12 << 20
#: Entries of a bucket of chunks or terms, on average.
BUCKET_ENTRIES = 200_000
#: Cells (kept terms x sources) that a task of the last step compares, on average.
AUDIT_CELLS = 500_000

LISTED = "bucket bigint, block bigint, place binary, chunks binary"
COUNTED = "lang string, bucket bigint, sources array<string>, terms binary, term binary, source binary, n_docs binary, n binary"
SUMMED = "lang string, bucket bigint, sources array<string>, terms binary, term binary, source binary, n binary"


def packed(a: np.ndarray) -> bytes:
    """Non-negative integers below 2^32 as compressed bytes; most are small, so equal bytes of all are put together."""
    return pa.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) + len(a).to_bytes(4, "little")


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[-4:], "little")
    return np.frombuffer(pa.decompress(raw[:-4], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


BLOCK = "block bigint, entries bigint, chunks binary, langs array<string>, sources array<string>, length binary, chunk binary, n binary, groups binary"


def factored(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs`` (lang, source, text): the distinct chunks (white space between them), the distinct (lang, source)
    groups, each document's number of chunks and its group, and the chunk and n of each (document, chunk)."""
    schema = arrow_schema(BLOCK)

    @lean
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        chunks, groups, length, chunk, n, of, size = {}, {}, [], [], [], [], 0

        def block() -> pa.RecordBatch:
            own = [packed(np.concatenate([np.zeros(0, np.int64), *c])) for c in (chunk, n)]
            return batch(schema, [(first + made, len(chunks), b" ".join(chunks), [g[0] for g in groups], [g[1] for g in groups], packed(np.array(length, np.int64)), *own, packed(np.array(of, np.int64)))])

        for rows in batches:
            for lang, source, text in zip(*rows.columns, strict=True):
                raw = (text.as_py() or "").encode()
                words = raw.split()
                of.append(groups.setdefault((lang.as_py() or "", source.as_py() or ""), len(groups)))
                own, times = np.unique(np.fromiter((chunks.setdefault(w, len(chunks)) for w in words), np.int64, len(words)), return_counts=True)
                length.append(len(own))
                chunk.append(own)
                n.append(times)
                size += len(raw)
                if len(of) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield block()
                    chunks, groups, length, chunk, n, of, size = {}, {}, [], [], [], [], 0
                    made += 1
        if of:
            yield block()

    return docs.mapInArrow(blocks, BLOCK)


def by_bucket(words: list[bytes], buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its words) by a hash of the words."""
    home = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(home, kind="stable")
    edges = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
    return [(int(home[order[a]]), order[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def listed_chunks(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's list of chunks, dealt to buckets of chunks."""
    schema = arrow_schema(LISTED)

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for block, raw in zip(*rows.columns, strict=True):
                words = raw.as_py().split()
                out = [(b, block.as_py(), packed(at), b" ".join([words[k] for k in at.tolist()])) for b, at in by_bucket(words, buckets)]
                if out:
                    yield batch(schema, out)

    return blocks.select("block", "chunks").mapInArrow(deal, LISTED)


def chunk_terms(listed: DataFrame) -> DataFrame:
    """(owner, place, terms): for each block's list of a bucket the terms of its chunks, those of a chunk with \\x01 between them
    (\\x02: none); each distinct chunk of a bucket is cut once."""
    schema = arrow_schema("owner bigint, place binary, terms binary")

    @lean
    def cut(bucket: pa.Table) -> pa.Table:
        known: dict[bytes, bytes] = {}
        out = []
        for block, place, raw in zip(*(bucket.column(c).to_pylist() for c in ("block", "place", "chunks")), strict=True):
            terms = []
            for w in raw.split():
                t = known.get(w)
                if t is None:
                    t = known[w] = b"\x01".join(TERM.findall(w)).lower() or b"\x02"
                terms.append(t)
            out.append((block, place, b" ".join(terms)))
        return pa.Table.from_batches([batch(schema, out)])

    return listed.groupBy("bucket").applyInArrow(cut, "owner bigint, place binary, terms binary")


def block_counts(block: pa.Table, resolved: pa.Table, buckets: int) -> list[tuple]:
    """Rows of COUNTED: the counts of a block by lang and bucket of terms."""
    #: Entries (place, term) of the block's chunks, terms numbered as they come.
    known: dict[bytes, int] = {}
    places, terms = [], []
    for place, raw in zip(resolved.column("place").to_pylist(), resolved.column("terms").to_pylist(), strict=True):
        for at, joined in zip(unpacked(place).tolist(), raw.split(b" "), strict=True):
            if joined != b"\x02":
                for t in joined.split(b"\x01"):
                    places.append(at)
                    terms.append(known.setdefault(t, len(known)))
    kinds = max(1, len(known))
    entry, repeats = np.unique(np.array(places, np.int64) * kinds + np.array(terms, np.int64), return_counts=True)
    place, term = entry // kinds, entry % kinds
    length, chunk, n, groups = (unpacked(block.column(c)[0].as_py()) for c in ("length", "chunk", "n", "groups"))
    begin = np.searchsorted(place, chunk, "left")
    many = np.searchsorted(place, chunk, "right") - begin
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    pair = np.repeat(np.repeat(np.arange(len(length)), length), many) * kinds + term[at]
    occurrences = np.repeat(n, many) * repeats[at]
    #: By document and term, then by group and term.
    order = np.argsort(pair, kind="stable")
    pair, occurrences = pair[order], occurrences[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    if not len(first):
        return []
    pair, occurrences = pair[first], np.add.reduceat(occurrences, first)
    key = groups[pair // kinds] * kinds + pair % kinds
    order = np.argsort(key, kind="stable")
    key, occurrences = key[order], occurrences[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n_docs, n = np.diff(np.append(first, len(key))), np.add.reduceat(occurrences, first)
    group, term = key[first] // kinds, key[first] % kinds
    langs, sources = (np.array(block.column(c)[0].as_py(), object) for c in ("langs", "sources"))
    words, out = list(known), []
    home = np.zeros(kinds, np.int64)
    for b, own in by_bucket(words, buckets):
        home[own] = b
    lang_of = {x: k for k, x in enumerate(dict.fromkeys(langs.tolist()))}
    lang = np.array([lang_of[x] for x in langs.tolist()], np.int64)[group]
    order = np.lexsort((term, home[term], lang))
    edges = np.flatnonzero(np.diff(lang[order] * buckets + home[term[order]], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:], strict=False):
        own = order[a:b]
        used, local = np.unique(term[own], return_inverse=True)
        out.append((langs[group[own[0]]], int(home[term[own[0]]]), sources.tolist(), b" ".join([words[t] for t in used.tolist()]), packed(local), packed(group[own]), packed(n_docs[own]), wide(n[own])))
    return out


def wide(a: np.ndarray) -> bytes:
    """64-bit integers."""
    return pa.compress(a.astype("<i8").tobytes(), codec="zstd", asbytes=True) + len(a).to_bytes(4, "little")


def unwide(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[-4:], "little")
    return np.frombuffer(pa.decompress(raw[:-4], 8 * n, codec="zstd", asbytes=True), "<i8")


def counted_blocks(blocks: DataFrame, resolved: DataFrame, buckets: int) -> DataFrame:
    schema = arrow_schema(COUNTED)

    @lean
    def count(block: pa.Table, terms: pa.Table) -> pa.Table:
        rows = block_counts(block, terms, buckets) if block.num_rows and terms.num_rows else []
        return pa.Table.from_batches([batch(schema, rows)])

    return blocks.drop("chunks", "entries").groupBy("block").cogroup(resolved.groupBy("owner")).applyInArrow(count, COUNTED)


def kept_terms(counted: DataFrame, least_docs: int) -> DataFrame:
    """A row for each lang and bucket with its kept terms: the sources that have some, and (term, source, n) entries.

    A lang keeps the terms in at least ``least_docs`` of its documents.
    """
    schema = arrow_schema(SUMMED)

    @lean
    def add(bucket: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        names: dict[str, int] = {}
        parts = []
        for sources, words, term, source, n_docs, n in zip(*(bucket.column(c).to_pylist() for c in ("sources", "terms", "term", "source", "n_docs", "n")), strict=True):
            number = np.fromiter((known.setdefault(w, len(known)) for w in words.split(b" ")), np.int64)
            of = np.array([names.setdefault(s, len(names)) for s in sources], np.int64)
            parts.append((number[unpacked(term)], of[unpacked(source)], unpacked(n_docs), unwide(n)))
        term, source, n_docs, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        docs = np.zeros(len(known), np.int64)
        np.add.at(docs, term, n_docs)
        kept = docs[term] >= least_docs
        key, where = np.unique(term[kept] * len(names) + source[kept], return_inverse=True)
        if not len(key):
            return schema.empty_table()
        total = np.zeros(len(key), np.int64)
        np.add.at(total, where, n[kept])
        used, local = np.unique(key // len(names), return_inverse=True)
        met, of = np.unique(key % len(names), return_inverse=True)  # a block also names the sources of its other langs
        words, sources = list(known), list(names)
        row = (bucket.column("lang")[0].as_py(), bucket.column("bucket")[0].as_py(), [sources[s] for s in met.tolist()], b" ".join([words[t] for t in used.tolist()]), packed(local), packed(of), wide(total))
        return pa.Table.from_batches([batch(schema, [row])])

    return counted.groupBy("lang", "bucket").applyInArrow(add, SUMMED)


def entries_of(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and term, source and n of the entries of a row of SUMMED."""
    return row["terms"].split(b" "), unpacked(row["term"]), unpacked(row["source"]), unwide(row["n"])


def totals(kept: DataFrame) -> DataFrame:
    """(lang, source, kinds, n): occurrences of kept terms by source, and a row with a null source for each lang and bucket that
    tells its number of kept terms."""
    schema = arrow_schema("lang string, source string, kinds bigint, n bigint")

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                words, _, source, n = entries_of(row)
                sums = np.zeros(len(row["sources"]), np.int64)
                np.add.at(sums, source, n)
                yield batch(schema, [(row["lang"], None, len(words), int(n.sum())), *[(row["lang"], s, 0, int(v)) for s, v in zip(row["sources"], sums, strict=True)]])

    return kept.mapInArrow(add, "lang string, source string, kinds bigint, n bigint")


def shares(n: np.ndarray, total: int | np.ndarray, kinds: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kinds)): smoothed shares in billionths."""
    if len(n) and int(n.max()) + 2 > (2**63 - 1) // SCALE:
        n, total = n.astype(object), np.asarray(total).astype(object)
    return np.asarray(1 + SCALE * (n + 2) // (total + 2 * kinds), np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most a billion and one, so 64 bits hold the square."""
    return (p - q) * (p - q) // (p + q)


def bucket_audit(rows: list[dict], sources: list[str], total: np.ndarray, kinds: int, lang_total: int, top: int) -> list[tuple]:
    """(source, part, item, value) of some buckets of a lang: their part of the sums over pairs of ``sources``, and the top terms of
    each source among theirs.  The buckets are matrices of shares, one after the other."""
    place = {s: k for k, s in enumerate(sources)}
    nowhere = shares(np.zeros(len(sources), np.int64), total, kinds)
    sums = np.zeros((len(sources), len(sources)), np.int64)
    best: list[list[tuple[int, bytes]]] = [[] for _ in sources]
    for row in rows:
        words, term, source, n = entries_of(row)
        source = np.array([place[s] for s in row["sources"]], np.int64)[source]
        p = np.tile(nowhere, (len(words), 1))
        p[term, source] = shares(n, total[source], kinds)
        for s in range(len(sources) - 1):
            sums[s, s + 1 :] += divergence(p[:, s + 1 :], p[:, s : s + 1]).sum(0)
        of_lang = np.zeros(len(words), np.int64)
        np.add.at(of_lang, term, n)
        own, q = p[term, source], shares(of_lang, lang_total, kinds)[term]
        more = np.flatnonzero(own > q)
        value = divergence(own[more], q[more])
        by_name = np.empty(len(words), np.int64)
        by_name[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
        order = np.lexsort((by_name[term[more]], -value, source[more]))
        at = more[order]
        first = np.flatnonzero(np.diff(source[at], prepend=-1))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        for k in np.flatnonzero(rank < top).tolist():
            best[source[at[k]]].append((-int(value[order[k]]), words[term[at[k]]]))
    out = [(s, "term", word.decode(), -value) for s, found in zip(sources, best, strict=True) for value, word in sorted(found)[:top]]
    for a in range(len(sources)):
        for b in range(a + 1, len(sources)):
            out += [(sources[a], "pair", sources[b], int(sums[a, b])), (sources[b], "pair", sources[a], int(sums[a, b]))]
    return out


@tidied
def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for the columns lang, source and text of ``docs``.

    Part ``pair``: every other source of the lang.  Part ``term``: the ``top`` terms that the source has more than its lang.
    Ranks run from 1 by value, descending, then item.  Null lang, source and text count as ''; every row is a document, repeated
    ones too; texts are read whole; a group without terms still is in part ``pair``; other columns are not read; an
    empty table gives no rows.
    """
    blank, least = F.lit(""), partitions(docs.sparkSession)
    groups = stored(docs.select(F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source")).distinct(), "source-groups")
    blocks = stored(factored(docs.select("lang", "source", "text")), "chunk-blocks")
    buckets = max(least, (blocks.agg(F.sum("entries")).first()[0] or 0) // BUCKET_ENTRIES)
    counted = counted_blocks(blocks, chunk_terms(listed_chunks(blocks, buckets)), buckets)
    kept = stored(kept_terms(counted, least_docs), "kept-terms")
    sums = stored(totals(kept), "kept-totals")
    langs = sums.where("source IS NULL").groupBy("lang").agg(F.sum("kinds").alias("kinds"), F.sum("n").alias("lang_total"))
    own = sums.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    facts = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kinds", "lang_total"])
    facts = stored(facts, "source-facts")
    #: Buckets are put together until a task has enough cells (terms x sources); its results are as many whatever the buckets.
    tasks = 1 + (facts.agg(F.sum("kinds")).first()[0] or 0) // AUDIT_CELLS
    dealt = kept.withColumn("task", F.pmod("bucket", F.lit(tasks)))
    known = dealt.select("lang", "task").distinct().join(facts, "lang").select(F.col("lang").alias("of"), F.col("task").alias("at"), F.col("source").alias("s"), "total", "kinds", "lang_total")
    schema = arrow_schema("lang string, source string, part string, item string, value bigint")

    @lean
    def audit(rows: pa.Table, known: pa.Table) -> pa.Table:
        known = known.take(pc.sort_indices(known, [("s", "ascending")]))
        found = bucket_audit(rows.to_pylist(), known.column("s").to_pylist(), known.column("total").to_numpy(), known.column("kinds")[0].as_py(), known.column("lang_total")[0].as_py(), top)
        return pa.Table.from_batches([batch(schema, [(rows.column("lang")[0].as_py(), *f) for f in found])])

    found = dealt.groupBy("lang", "task").cogroup(known.groupBy("of", "at")).applyInArrow(audit, "lang string, source string, part string, item string, value bigint")
    found = stored(found, "bucket-audits")
    #: A lang that keeps no term has pairs, too.
    bare = facts.where("kinds = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.unionByName(none).withColumn("rank", rank).unionByName(found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


OP12_SQL = r"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
occ AS (SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v))::HUGEINT AS p FROM dense JOIN v USING (lang)),
ld AS (SELECT lang, term, sum(c) AS c FROM dense GROUP BY lang, term),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v))::HUGEINT AS q FROM ld JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@llm_query("op12_source_divergence", OP12_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
