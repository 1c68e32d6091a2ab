"""Periodic runs of words by maximal-pair enumeration (operator 13).

A run with period q and length L is a stretch of words that equals itself shifted by q and that no neighbouring word
extends.  So its first word i and the word i + q begin a *maximal pair*: their suffixes share exactly
L - q words, and the words left of them differ (or there is none).  A run of length at least max(6, 4q) is thus a maximal pair at
distance q that shares at least max(5, 3q) words, and the pair names start, period and length: nothing is extended.

For each text the suffixes that share 5 words with another one are sorted (prefix doubling from 5-word ranks), their
longest common prefixes span the interval tree, and the tree is walked bottom-up with lists of positions by the word to
the left.  Where two children of an interval with prefix l meet, the positions of the smaller one look for positions
of the larger one under another left word within distance l / 3.  In such a window, occurrences of the prefix follow
each other by its period and all but the first of them have the same word to the left, so few pairs are met, at most a
few for each repeat in the text.  Pairs with the same start and length are one run; its period is the smallest distance.

Most texts have no run: a run leaves a stretch of positions whose five words come again later, at least 3q - 4
positions long, where q is at least the smallest distance to the next occurrence in the stretch.  Texts without such a
stretch end there.  Words are exact small integers, a dictionary for each slice of texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import llm_query

#: A run has at least LEAST words and at least TIMES periods.
LEAST, TIMES = 6, 4
#: Words that a maximal pair shares at least: max(LEAST - q, (TIMES - 1) * q) over all q.
SHARED = 5
#: A slice of texts ends with the one that takes it to this many bytes.
SLICE_BYTES = 4 << 20

Run = tuple[int, int, int]


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of rows of non-negative integers."""
    out = keys[0]
    for k in keys[1:]:
        out = np.unique(out, return_inverse=True)[1] * (int(k.max(initial=0)) + 1) + k
    return np.unique(out, return_inverse=True)[1] + 1


def _shifted(a: np.ndarray, by: int) -> np.ndarray:
    """``a`` from place ``by`` on, filled up with zeros."""
    out = np.zeros_like(a)
    out[: max(0, len(a) - by)] = a[by:]
    return out


def five_ranks(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For the words of several texts (``text`` numbers them): equal numbers where the same five words of a text begin.
    Places with fewer than five words before the text's end have numbers that none shares."""
    key = ids + 1
    two = _ranks(text, key, np.where(_shifted(text + 1, 1) == text + 1, _shifted(key, 1), 0))
    four = _ranks(two, np.where(_shifted(text + 1, 2) == text + 1, _shifted(two, 2), 0))
    return _ranks(four, np.where(_shifted(text + 1, 4) == text + 1, _shifted(key, 4), 0))


def may_have_runs(five: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The texts that have a stretch as above."""
    n = len(five)
    order = np.argsort(five, kind="stable")
    gap = np.full(n, np.iinfo(np.int64).max)
    same = five[order][1:] == five[order][:-1]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    again = np.flatnonzero(gap < np.iinfo(np.int64).max)
    if not len(again):
        return again
    first = np.flatnonzero(np.concatenate([[True], (again[1:] != again[:-1] + 1) | (text[again[1:]] != text[again[:-1]])]))
    long = np.diff(np.append(first, len(again)))
    return np.unique(text[again[first[long >= 3 * np.minimum.reduceat(gap[again], first) - 4]]])


def _sorted_suffixes(five: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order of one text and the words that neighbours share, counted from SHARED on (0: fewer).

    ``five`` must order nothing but tell five-word windows apart; so the order is one of the windows, not of words.
    """
    levels, step = [np.unique(five, return_inverse=True)[1] + 1], SHARED
    n = len(five)
    while int(levels[-1].max()) < n:
        levels.append(_ranks(levels[-1], _shifted(levels[-1], step)))
        step *= 2
    order = np.empty(n, np.int64)
    order[levels[-1] - 1] = np.arange(n)
    shared = np.zeros(n - 1, np.int64)
    for rank in reversed(levels):
        a, b = order[:-1] + shared, order[1:] + shared
        inside = np.maximum(a, b) < n
        equal = np.zeros(n - 1, bool)
        equal[inside] = rank[a[inside]] == rank[b[inside]]
        shared[equal] += step
        step //= 2
    return order, shared


def _words_shared(order: np.ndarray, shared: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """``shared`` is a multiple of five; the up to four words after it are compared one by one."""
    n = len(ids)
    on = shared > 0
    for _ in range(SHARED - 1):
        a, b = order[:-1] + shared, order[1:] + shared
        on &= np.maximum(a, b) < n
        on[on] = ids[a[on]] == ids[b[on]]
        shared[on] += 1
    return shared


class _Positions:
    """Positions of an interval, all of them and by the word to the left, each list in order."""

    __slots__ = ("all", "by_left")

    def __init__(self, at: int, left: int):
        self.all, self.by_left = [at], {left: [at]}


def _met(small: _Positions, large: _Positions, shared: int, found: dict[tuple[int, int], int]) -> None:
    """Note the runs of all maximal pairs between two children of an interval."""
    reach = shared // (TIMES - 1)
    for left, positions in small.by_left.items():
        for i in positions:
            a, b = bisect_left(large.all, i - reach), bisect_right(large.all, i + reach)
            if a == b:
                continue
            lists = [large.all[a:b]] if b - a <= 2 else [p[bisect_left(p, i - reach) : bisect_right(p, i + reach)] for word, p in large.by_left.items() if word != left or left < 0]
            own = large.by_left.get(left, []) if left >= 0 else []
            for near in lists:
                for j in near:
                    if b - a <= 2 and own:
                        at = bisect_left(own, j)
                        if at < len(own) and own[at] == j:
                            continue
                    q = abs(i - j)
                    if shared + q >= LEAST:
                        key = (min(i, j), shared + q)
                        if q < found.get(key, q + 1):
                            found[key] = q


def _joined(small: _Positions, large: _Positions) -> _Positions:
    for at in small.all:
        insort(large.all, at)
    for left, positions in small.by_left.items():
        own = large.by_left.get(left)
        if own is None:
            large.by_left[left] = positions
        else:
            for at in positions:
                insort(own, at)
    return large


def runs_of(ids: np.ndarray, five: np.ndarray | None = None) -> list[Run]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    if len(ids) < LEAST:
        return []
    if five is None:
        five = five_ranks(ids, np.zeros(len(ids), np.int64))
    order, shared = _sorted_suffixes(five)
    shared = _words_shared(order, shared, ids)
    left = np.concatenate([[-1], ids[:-1]]).tolist()
    found: dict[tuple[int, int], int] = {}
    order, shared = order.tolist(), shared.tolist()
    open_: list[tuple[int, _Positions]] = []  # prefix of an interval that may still grow, its positions so far
    here = _Positions(order[0], left[order[0]]) if shared[0] >= SHARED else None
    for k, at in enumerate(order[1:]):
        prefix = shared[k]
        if prefix >= SHARED and here is None:
            here = _Positions(order[k], left[order[k]])
        while open_ and open_[-1][0] > prefix:
            above, wide = open_.pop()
            here = _merge(wide, here, above, found)
        if prefix < SHARED:
            here = None
            continue
        if open_ and open_[-1][0] == prefix:
            here = _merge(open_.pop()[1], here, prefix, found)
        open_.append((prefix, here))
        here = _Positions(at, left[at])
    while open_:
        above, wide = open_.pop()
        here = _merge(wide, here, above, found)
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2]))


def _merge(a: _Positions, b: _Positions, shared: int, found: dict[tuple[int, int], int]) -> _Positions:
    small, large = (a, b) if len(a.all) <= len(b.all) else (b, a)
    _met(small, large, shared, found)
    return _joined(small, large)


def without_repeats(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def best_run(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


FIELDS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _row(words: list[bytes], runs: list[Run]) -> dict:
    best = best_run(runs)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = [w for w, stays in zip(words, without_repeats(len(words), runs).tolist(), strict=True) if stays] if runs else words
    start, length, period = best or (None, None, None)
    return {"n_runs": len(runs), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if best else None,
            "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}


def slice_rows(texts: list[list[bytes]]) -> list[dict]:
    """The result of each text of a slice, given as words."""
    table: dict[bytes, int] = {}
    ids = np.array([table.setdefault(w, len(table)) for words in texts for w in words], np.int64)
    length = np.array([len(words) for words in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), length)
    runs: list[list[Run]] = [[] for _ in texts]
    if len(ids):
        five = five_ranks(ids, text)
        end = np.cumsum(length)
        for k in may_have_runs(five, text).tolist():
            a, b = end[k] - length[k], end[k]
            runs[k] = runs_of(ids[a:b], five[a:b])
    return [_row(words, found) for words, found in zip(texts, runs, strict=True)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def periodic_from(words: list[bytes], start: int | None, period: int | None) -> list[bytes]:
    """``words`` with those from ``start`` on replaced by repeats of the ``period`` words there; unchanged if ``start`` is null."""
    if start is None or not words:
        return words
    start, n = start % len(words), len(words)
    period = 1 + (n - start) // period
    cycle = words[start : start + period]
    return words[:start] + (cycle * ((n - start) // len(cycle) + 1))[: n - start]


def run_columns(text: Column, start: Column | None = None, parts: Column | None = None) -> Column:
    """A struct of n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of a text's words.

    With ``start`` and ``parts``, the words from number ``start`` modulo n on are first made periodic: with n words and
    a = start modulo n, the period is 1 + floor((n - a) / parts).
    """
    @F.arrow_udf(f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    def find(texts: pa.Array, starts: pa.Array, each: pa.Array) -> pa.Array:
        kinds = pa.struct([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in FIELDS.split(", ")])
        out, waiting, size = [], [], 0
        for t, s, e in zip(texts, starts, each, strict=True):
            waiting.append(periodic_from(words_of(t.as_py()), s.as_py(), e.as_py()))
            size += sum(map(len, waiting[-1]))
            if size >= SLICE_BYTES:
                out += slice_rows(waiting)
                waiting, size = [], 0
        return pa.array(out + slice_rows(waiting), kinds)

    null = F.lit(None).cast("long")
    return find(text, null if start is None else start, null if parts is None else parts)


def periodic_runs(docs: DataFrame, text: str = "text", start: Column | None = None, parts: Column | None = None) -> DataFrame:
    """``docs`` with n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256; row by row, no shuffle.

    Columns of these names are replaced, all others stay; repeated rows each keep their result.  A null or empty text has no runs and
    nulls for the best one; very long texts are read whole; an empty table stays empty.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    spare = "_runs"
    while spare in docs.columns:
        spare += "_"
    found = docs.withColumn(spare, run_columns(F.col(text), start, parts))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *[F.col(f"{spare}.{c}").alias(c) for c in names])


@llm_query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document by hash is made periodic first; a null doc_id has no hash and stays as it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    return periodic_runs(docs, start=F.when(h % 10 == 0, g), parts=3 + g % 8).drop("text")
