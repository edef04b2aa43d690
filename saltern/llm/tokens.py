"""Token ids and token counts by public vocabularies, through caches of space-delimited pieces.

Pieces are cut where the tokenizer's own pre-tokenization always cuts, so a piece's tokens never depend on its
neighbours and equal pieces can be looked up. Texts for which that does not hold (special strings, runs of spaces,
control marks) are encoded whole by the ``tokenizers`` library. Misses of common Latin pieces are encoded by the same
merges through ``tiktoken``; all others by ``tokenizers``. Both give the same ids, which the tests check.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Entries and bytes a worker's cache holds before it starts anew; pieces of more characters are encoded each time.
CACHE_ENTRIES, CACHE_BYTES, CACHED_CHARS = 600_000, 64 << 20, 256
#: Code points below this go through the fast path; their classes and cases are alike in all Unicode versions in use.
PLAIN_BELOW = 0x250
_NOT_PLAIN = re.compile(f"[^\\x01-{chr(PLAIN_BELOW - 1)}]")
_ODD_SPACE = re.compile(r"\s (?:\s|\Z)")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow 0x100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Cache(dict):
    """piece -> value, filled by ``encode`` on a miss and emptied when full."""

    def __init__(self, encode, seed=()):
        super().__init__(seed)
        self.encode, self.seed, self.bytes = encode, seed, 0

    def __missing__(self, piece):
        out = self.encode(piece)
        if len(piece) > CACHED_CHARS:
            return out
        if len(self) >= CACHE_ENTRIES + len(self.seed) or self.bytes >= CACHE_BYTES:
            self.clear()
            self.update(self.seed)
            self.bytes = 0
        self.bytes += len(piece) + (len(out) if isinstance(out, bytes) else 8)
        self[piece] = out
        return out


class ByteCounter:
    """Token counts of a byte-level vocabulary with the usual pre-token pattern."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        back = _byte_alphabet()
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in back for c in t)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        for s in self.special:
            ranks.pop(s.encode(), None)
        self.library = _library(path)
        # the pre-token pattern of byte-level vocabularies, a fixed value
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        frequent = frequent or {}
        self.first = _Cache(self.piece)
        self.rest = _Cache(lambda p: self.piece(" " + p), frequent)

    def piece(self, text: str) -> int:
        if _NOT_PLAIN.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return len(self.fast(text))

    def count(self, text: str) -> int:
        if _ODD_SPACE.search(text) or any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        head, *tail = text.split(" ")
        return self.first[head] + sum(map(self.rest.__getitem__, tail))


class WordEncoder:
    """Little-endian ids of a lower-casing vocabulary whose pre-tokens end words and drop white space.

    Two caches: whole space-delimited pieces, and the pre-tokens that pieces consist of.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        back, vocab, end = _byte_alphabet(), spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        # byte 0 marks the end of a word; merging it into the last byte comes before every other merge
        ranks = {}
        for t, i in vocab.items():
            body = t.removesuffix(end) if t != end else t
            if all(c in back for c in body):
                raw = bytes(back[c] for c in body)
                ranks.setdefault(raw + b"\0" if body != t else raw, i)
        self.library = _library(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 0x10000 else "<u4")
        # the vocabulary's own pre-token pattern, a fixed value
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.fast = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pre_tokens = _Cache(lambda t: array(self.dtype.char, self.fast(t + "\0")).tobytes())
        self.cache = _Cache(self.piece)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, raw: bytes) -> bytes:
        text = raw.decode()
        if _NOT_PLAIN.search(text) or not unicodedata.is_normalized("NFC", text):
            return self.whole(text)
        low = text.lower()
        if _NOT_PLAIN.search(low):
            return self.whole(text)
        if low.isalpha():
            return self.pre_tokens[low]
        body, last = low[:-1], low[-1]
        if body.isalpha() and last in ".,!?;:":  # the usual ends of words, cut off without the pattern
            return self.pre_tokens[body] + self.pre_tokens[last]
        return b"".join(map(self.pre_tokens.__getitem__, self.split(low)))

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return self.whole(text)
        return b"".join(map(self.cache.__getitem__, text.encode().split()))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
