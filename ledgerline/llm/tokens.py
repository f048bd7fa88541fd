"""Splitting texts into pre-tokens for the two public BPE vocabularies.

Pre-tokens of common scripts are cut with the ``regex`` module; a text with any
other character goes through the tokenizers library's own normaliser and
pre-tokeniser, so that Unicode versions can never differ.  The vocabulary's
path is a parameter everywhere; a file is read once per worker.
"""

from __future__ import annotations

import functools
import json

import regex

# Characters for which regex's letter, digit and white-space classes, lower
# case and NFC are settled: ASCII, Latin letters with marks, common punctuation.
PLAIN = regex.compile("[\t-\r -~¡-įı-ňŊ-ǃǍ-ǯ‐-‧€]*").fullmatch

# The byte-level pre-token pattern of the 50k byte vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 bytes stand for themselves, the rest take
    the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def definition(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@functools.lru_cache(maxsize=4)
def special_splitter(path: str):
    """(pattern of the special strings or None, id of each)."""
    ids = {t["content"]: t["id"] for t in definition(path)["added_tokens"]}
    return (regex.compile("|".join(regex.escape(x) for x in sorted(ids, key=len, reverse=True))) if ids else None), ids


class Recent(dict):
    """A lookup table of bounded size in two generations: when the young one
    is full, what was not used since the last turn is forgotten."""

    def __init__(self, kept: int):
        super().__init__()
        self.kept, self.old = kept, {}

    def fresh(self, wanted: set) -> list:
        """The keys that are in neither generation; others become young."""
        new = wanted.difference(self)
        if len(self) + len(new) > self.kept:
            self.old, new = dict(self), wanted
            self.clear()
        old = self.old
        for w in new.intersection(old):
            self[w] = old[w]
        return list(new.difference(old))
