"""Token counting for byte-level BPE files: whole-token table first, merges for the rest.

A text is cut at added tokens, then at single spaces, where no pre-token can cross; each chunk
is normalised and cut into pre-tokens by the tokenizer's own pattern (by the library itself where a chunk isn't
ASCII, as libraries differ in which code points are letters).  A pre-token that the *whole-token table* holds is one
token; only the others go through the library's merges.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex
from tokenizers import Tokenizer


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next free one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + rest.index(b)) for b in range(256)]


class _Memo(dict):
    """Chunk -> count.  Holds ``limit`` new chunks and as many older ones; long chunks are not kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, chunk: str) -> int:
        n = self.older.get(chunk)
        if n is None:
            n = self.make(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[chunk] = n
        return n


class TokenCounter:
    """Counts of one tokenizer file whose pre-tokens hold no white space.

    ``memo`` bounds the chunks that a worker remembers.
    """

    def __init__(self, path: str, memo: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with strip, word or normalisation rules are not supported")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if r"\s+" in pattern or spec["model"]["end_of_word_suffix"] is None:
            raise ValueError("only patterns that drop white space are supported")
        library = Tokenizer.from_file(path)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut_added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pattern = regex.compile(pattern)
        self.normalizer, self.merges = library.normalizer, library.model
        self.edges = library.pre_tokenizer
        self.suffix, self.letters = spec["model"]["end_of_word_suffix"], byte_letters()
        self.whole = self._whole_tokens(spec["model"]["vocab"])
        self.whole_letters = frozenset("".join([self.letters[b] for b in t.encode()]) for t in self.whole)
        self.counts = _Memo(self._count_chunk, memo)

    def _whole_tokens(self, vocab: dict[str, int]) -> frozenset[str]:
        """Pre-tokens proven to be one token: each vocabulary string that the pattern keeps in one
        piece, that no normalisation changes and that the merges turn into exactly its own id."""
        back = {c: b for b, c in enumerate(self.letters)}
        whole = set()
        for entry, i in vocab.items():
            body = entry.removesuffix(self.suffix)
            if not body or body == entry or any(c not in back for c in body):
                continue
            try:
                text = bytes(back[c] for c in body).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if self.normalizer.normalize_str(text) == text and self.pattern.findall(text) == [text] and [t.id for t in self.merges.tokenize(body)] == [i]:
                whole.add(text)
        return frozenset(whole)

    def _count_chunk(self, chunk: str) -> int:
        if not chunk.isascii():
            pieces = self.edges.pre_tokenize_str(self.normalizer.normalize_str(chunk))  # in byte letters
            return sum(1 if p in self.whole_letters else len(self.merges.tokenize(p)) for p, _ in pieces)
        n = 0
        for p in self.pattern.findall(chunk.lower()):
            if p in self.whole:
                n += 1
            else:
                n += len(self.merges.tokenize(p if p.isprintable() else "".join([self.letters[b] for b in p.encode("utf-8")])))
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty have none."""
        if not text:
            return 0
        parts = self.cut_added.split(text) if self.cut_added else [text]
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, p.split(" "))) for p in parts)


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    """The worker's counter for a vocabulary file."""
    return TokenCounter(path)
