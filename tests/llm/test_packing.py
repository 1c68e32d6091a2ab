"""Packing: exact token ids, no gaps, few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlens.llm.packing import pack, pack_documents, pack_plan, sequences, slots, tokenised_pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_places_each_length_once(lengths):
    plan = pack_plan(Counter(lengths), 64)
    placed = Counter()
    for kind, k in plan:
        assert k > 0 and sum(kind) <= 64 and sum(3 * n > 64 for n in kind) <= 2
        for n in kind:
            placed[n] += k
    assert placed == Counter(lengths)
    ends = defaultdict(int)
    for n, a, b, *_ in slots(plan):
        assert a == ends[n] and b > a
        ends[n] = b
    assert dict(ends) == dict(Counter(lengths))


def test_plan_is_near_the_bound():
    rng = random.Random(4)
    lengths = [min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(20_000)]
    bins = sum(k for _, k in pack_plan(Counter(lengths)))
    assert bins <= -(-sum(lengths) // 2048) * 1.005 + 1


def check(rows, ids_of):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    docs = defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
    for i, parts in docs.items():
        ids, at = ids_of(i), 0
        for k, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(by)


def test_documents(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "Ünï <|endoftext|>  \n\n x" * 30), (10**6 + 3, "word " * 9000)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    rows = pack_documents(docs).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    n = check(rows, ids.get)
    assert n <= -(-sum(map(len, ids.values())) // 2048) + 2


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(k, "some words here " * (k % 7 * 100)) for k in range(40)], "doc_id long, text string")
    packed = pack_documents(docs, with_ids=True)
    assert packed.agg({"length": "sum"}).first()[0] == sequences(packed).agg({"n_tokens": "sum"}).first()[0]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in sequences(packed).collect())


def test_repeated_rows_and_nulls_are_pieces_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    pieces = tokenised_pieces(docs)
    rows = pack(pieces).collect()
    assert len(rows) == 4 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4


def test_very_long_white_space_and_odd_code_points():
    import public_tokenizers
    import random
    from flowlens.llm.packing import _encoding, token_ids
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = _encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    spaces = " " * 1_000_500
    texts = [" " * 2_000_000, "\t" * 1_200_000 + "x", "a" + " \n" * 600_000 + " b", spaces + "<|endoftext|>" + spaces + "z", "q  " * 3 + "\u00a0" + spaces + "\u00e9"]
    rng = random.Random(2)
    texts += ["".join(chr(k) for k in (rng.randrange(0x110000) for _ in range(6)) if not 0xD800 <= k < 0xE000) for _ in range(4000)]
    for t in texts:
        assert token_ids(own, t).tolist() == library.encode(t, add_special_tokens=False).ids
