"""Token counts equal the library's on real texts, odd characters, special strings and empty texts."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from flowlens.llm.bpe import TokenCounter
from flowlens.llm.token_counts import count_tokens, op1_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = list("aAbZéÉßΣσςİıǅ'sS0١²½ \n\t\r\x0b\x1c\x85.,!?$日本語😀ΩKſ<|>") + ["<|endoftext|>", "<|startoftext|>", "'ll", "  ", "\n\n", "́"]


def test_counts_equal_the_library():
    library, own = Tokenizer.from_file(PATH), TokenCounter(PATH, memo=50)
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [f"a{chr(c)} {chr(c)}b" for c in range(0x3000) if not 0xD800 <= c < 0xE000] + ["", "x" * 50_000, "the cat " * 20_000]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.count(t) for t in texts] == want and own.count(None) == 0


def test_whole_tokens_are_one_token():
    library, own = Tokenizer.from_file(PATH), TokenCounter(PATH)
    some = sorted(own.whole)[::50]
    assert len(own.whole) > 30_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(some, add_special_tokens=False))


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(1, None, 7), (2, "", 7), (2, "", 7), (3, "héllo <|endoftext|>", 7), (None, "a " * 3000, 7)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got] == [(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 20, 4, False), (None, 6000, 3000, True)]
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_the_table(spark, sf):
    library = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in op1_token_counts(spark, sf).collect()} == want


def test_all_planes_count_as_the_library_does():
    import random

    import public_tokenizers
    from flowlens.llm.bpe import counter
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), counter(path), random.Random(4)
    texts = ["\u00c5\U0003f8cd", "/-\U0003f13a", "\U0001f600\U0003fa03"]
    for _ in range(20_000):
        points = [rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x110000)]) for _ in range(rng.randint(1, 7))]
        texts.append("".join(chr(k) for k in points if not 0xD800 <= k < 0xE000))
    for t in texts:
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), [hex(ord(c)) for c in t]
