"""The pipeline against its stages' rules: what each stage keeps, and what comes out."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowlens.llm.common import stored
from test_jaccard_join import shingles


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], sf), name))
    assert all(d.columns == columns for d in seen[:-1])
    start, good, unique, apart, mix, packed = ([r.asDict() for r in d.collect()] for d in seen)
    assert len(start) > len(good) >= len(unique) >= len(apart)
    first = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        first.setdefault(" ".join((r["text"] or "").split()), r["doc_id"])
    assert sorted(first.values()) == sorted(r["doc_id"] for r in unique)
    sets = [shingles(r["text"]) for r in apart]
    assert all(not a or 100 * len(a & b) < 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    times = Counter(r["doc_id"] for r in mix)
    assert set(times.values()) <= {1, 2} and set(times) <= {r["doc_id"] for r in apart}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in mix}
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    want = Counter()
    for i, n in times.items():
        ids = library.encode(text[i] or "", add_special_tokens=False).ids + [0]
        edges = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for a, b in zip(edges, edges[1:]):
            want[i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += n
    assert got == want
    key = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)
    again = [(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(again) == key
