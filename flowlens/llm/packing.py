"""Best-fit packing of token sequences with large-item matching (operator 4).

The plan is made on the histogram of piece lengths, whose size depends on the capacity alone:
pieces of one length are interchangeable.  Pieces then find their place by their exact rank
within their length.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.common import llm_query, partitions, stored

CAPACITY = 2048
END_ID = 0
#: Fixed id of the one special token of the vocabulary.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


#: A run of white space that is encoded beside the pattern, where the pattern fails.
_RUN = regex.compile(r"\p{White_Space}{1024,}")


def token_ids(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a whole text.

    The pattern looks back over a run of white space and gives up on very long ones.  Such a text is cut at its special
    tokens and long runs: a run is a pre-token without its last character, or all of it before a special token or the end.
    """
    try:
        return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4")
    except ValueError:
        ids: list[int] = []
        for number, part in enumerate(regex.split("|".join(map(regex.escape, SPECIAL)), text)):
            ids += [*SPECIAL.values()] if number else []
            done = 0
            for run in _RUN.finditer(part):
                end = run.end() if run.end() == len(part) else run.end() - 1
                ids += encoding.encode_ordinary(part[done : run.start()])
                ids += encoding._encode_single_piece(part[run.start() : end])
                done = end
            ids += encoding.encode_ordinary(part[done:])
        return np.array(ids, "<u4")


def tokenised_pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: the other columns of ``docs``, then piece, start, length, ids_crc32 (and ids, little-endian
    unsigned 32-bit, on request).

    A document is its token ids and the end id, so a null or empty text is one piece of length 1.  A longer document is
    cut into pieces of ``capacity`` tokens of which the first holds what is left over.  The ids are those of
    byte_bpe_50k.json; they are read from the rank file of the same vocabulary.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    fields = "piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (",ids:binary" if with_ids else "")

    @F.arrow_udf(f"array<struct<{fields}>>")
    def cut(texts: pa.Array) -> pa.Array:
        encoding, offsets, rows = _encoding(path), [0], []
        for t in texts:
            ids = np.append(token_ids(encoding, t.as_py() or ""), np.uint32(END_ID)).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            edges = [0, *range(first, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                raw = ids[a:b].tobytes()
                rows.append((k, a, b - a, zlib.crc32(raw), raw if with_ids else None))
            offsets.append(len(rows))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["piece", "start", "length", "ids_crc32", "ids"][: 5 if with_ids else 4]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t, _ in zip(columns, types, names, strict=False)], names))

    new = [f.split(":")[0] for f in fields.split(",")]
    kept = [c for c in docs.columns if c != text and c not in new]
    return docs.select(*kept, F.explode(cut(F.col(text))).alias("_p")).select(*kept, *[F.col(f"_p.{c}").alias(c) for c in new])


def pack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins) from length -> count.

    1. Large lengths, above a third of the capacity: at most two share a bin.  The largest is
       matched with the largest other one that fits beside it.
    2. Smaller lengths, largest first, go where the smallest gap that fits them is; a new bin is
       opened only when there is none.
    Each step uses up a length or a kind of bin, so the work depends on the capacity, not on the data.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a length lies outside 1..capacity")
    kinds: list[tuple[tuple[int, ...], int]] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] == 1:
            b = large[at - 1] if at >= 1 else None
        if b is None:
            kinds.append(((a,), left[a]))
            left[a] = 0
        else:
            k = left[a] // 2 if a == b else min(left[a], left[b])
            kinds.append(((a, b), k))
            left[a] -= k
            left[b] -= k
        large = [n for n in large if left[n]]
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for lengths, k in kinds:
        gaps[capacity - sum(lengths)].append((lengths, k))
    order = sorted(gaps)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(order, n)
            if at < len(order):
                gap = order[at]
                lengths, k = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(at)
            else:
                gap, lengths, k = capacity, (), todo
            each = gap // n
            if todo < each:
                each, full = todo, 1
            else:
                full = min(k, todo // each)
            todo -= each * full
            if k > full and lengths:
                if not gaps[gap]:
                    bisect.insort(order, gap)
                gaps[gap].append((lengths, k - full))
            rest = gap - each * n
            if not gaps[rest]:
                bisect.insort(order, rest)
            gaps[rest].append((lengths + (n,) * each, full))
    return [kind for g in sorted(gaps) for kind in gaps[g]]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of this length in a sequence, offset of the first)."""
    out, used, sequence = [], defaultdict(int), 0
    for lengths, k in plan:
        offset = 0
        for n in dict.fromkeys(lengths):
            each = lengths.count(n)
            out.append((n, used[n], used[n] + each * k, sequence, each, offset))
            used[n] += each * k
            offset += each * n
        sequence += k
    return out


def ranked_by_length(pieces: DataFrame, id_col: str) -> DataFrame:
    """``pieces`` with _rank: 0, 1, 2, ... within each length, without a task per length.

    Hash buckets cut every length; a bucket's first rank comes from the (length, bucket) counts.
    """
    buckets = 4 * partitions(pieces.sparkSession)
    cut = pieces.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    counts = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(id_col, "piece", "start", "ids_crc32")) - 1
    return cut.withColumn("_place", place).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_place")).drop("_first", "_place", "_bucket")


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with length) with sequence_id and offset; every piece is placed, offsets have no gaps.

    Repeated rows are pieces of their own.  The driver sees one count per length (at most ``capacity`` rows) and
    the plan made of them, which is broadcast; its size is bounded by the capacity.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = slots(pack_plan(histogram, capacity))
    table = spark.createDataFrame(rows, "length bigint, _a bigint, _b bigint, _seq bigint, _each bigint, _off bigint")
    ranked = ranked_by_length(pieces, id_col)
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_a")) & (F.col("_rank") < F.col("_b"))).drop(table["length"])
    at = F.col("_rank") - F.col("_a")
    return placed.withColumns({"sequence_id": F.col("_seq") + F.floor(at / F.col("_each")).cast("long"), "offset": F.col("_off") + (at % F.col("_each")) * F.col("length")}).drop("_rank", "_a", "_b", "_seq", "_each", "_off")


def pack_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack; one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = stored(tokenised_pieces(docs.select("doc_id", "text"), with_ids=with_ids), "pieces")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return pack(pieces).select(*out)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (the pieces' ids in order of offset).

    ``packed`` has ids (``with_ids``).  A sequence has at most ``capacity`` pieces, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", joined.alias("ids"))


@llm_query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
