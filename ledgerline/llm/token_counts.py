"""Token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a batch's words that are new to the worker are laid out as
one ragged array of symbols.  In each round every pre-token finds its
lowest-ranked adjacent pair and applies it at once (all places of that pair,
left to right); pre-tokens without a known pair drop out.  What survives is
counted.  The counts of earlier words are kept in a table of bounded size.

Defined cases: a NULL or empty text has 0 tokens; special strings inside a
text count as one token each, as the library's default has it.
"""

from __future__ import annotations

import functools
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import id_text, lengths, pieces
from ledgerline.llm.tokens import PLAIN, Recent, byte_alphabet, definition, public_path, special_splitter, tokenizer

NONE = 1 << 40     # rank of a pair that the vocabulary doesn't merge
KEPT = 600_000     # words whose counts a worker remembers


class Merges:
    """Merge table of a byte-level BPE vocabulary, as sorted arrays."""

    def __init__(self, path: str):
        model = definition(path)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.symbol = np.array([vocab.get(c, -1) for c in alphabet], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in alphabet], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # open addressing: place of each pair's rank; a pair goes to its first free place
        self.bits = max(4, int(4 * len(key) - 1).bit_length())
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        at, todo = self._home(key), np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.key[at[todo]] == -1]
            _, one = np.unique(at[free], return_index=True)
            done = free[one]
            self.key[at[done]], self.rank[at[done]] = key[done], done
            todo = np.setdiff1d(todo, done)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if there is none."""
        k = a << 32 | b
        at = self._home(k)
        found = self.key[at]
        out = np.where(found == k, self.rank[at], NONE)
        todo = np.flatnonzero((found != k) & (found != -1))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[todo]]
            hit = found == k[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return np.where((a >= 0) & (b >= 0), out, NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) word after all merges."""
        size = np.array([len(w) for w in words], np.int64)
        sym = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(size)
        sym[ends - 1] = self.final[np.frombuffer(bytes(w[-1] for w in words), np.uint8)]
        out, alive = size.copy(), np.flatnonzero(size > 1)
        word = np.repeat(np.arange(len(words)), size)
        keep = size[word] > 1
        sym, word = sym[keep], word[keep]
        while len(alive):
            same = word[:-1] == word[1:]
            rank = np.full(len(sym), NONE, np.int64)
            i = np.flatnonzero(same)
            rank[i] = self.lookup(sym[i], sym[i + 1])
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(rank, start)
            group = np.cumsum(np.concatenate([[0], ~same]))
            go = least[group] < NONE
            here = np.flatnonzero((rank == least[group]) & go)
            if len(here):
                # a run of overlapping places (a a a): every second one, from its left end
                fresh = np.concatenate([[True], np.diff(here) != 1])
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(here)), 0))
                here = here[(np.arange(len(here)) - first) % 2 == 0]
                sym[here] = self.made[rank[here]]
                stay = go.copy()
                stay[here + 1] = False
                out -= np.bincount(word[here], minlength=len(out))
            else:
                stay = go
            sym, word = sym[stay], word[stay]
            alive = start if len(sym) else sym
        return out


@functools.lru_cache(maxsize=2)
def _counter(path: str):
    return Merges(path), Recent(KEPT)


def _normal(path: str) -> tuple:
    """The split pattern, and whether the normaliser is the known plain one
    (NFC, white space to one blank, lower case)."""
    d = definition(path)
    split = next((p for p in d["pre_tokenizer"].get("pretokenizers", [d["pre_tokenizer"]]) if p["type"] == "Split"), None)
    kinds = [n["type"] for n in (d["normalizer"] or {}).get("normalizers", [])]
    known = split is not None and kinds == ["NFC", "Replace", "Lowercase"] and split["behavior"] == "Removed" and split["invert"]
    return (regex.compile(split["pattern"]["Regex"]) if known else None), known


def slow_words(text: str, path: str) -> list[bytes]:
    """Pre-tokens by the library's own normaliser and pre-tokeniser."""
    t, back = tokenizer(path), {c: b for b, c in enumerate(byte_alphabet())}
    if t.normalizer is not None:
        text = t.normalizer.normalize_str(text)
    return [bytes(back[c] for c in w) for w, _ in t.pre_tokenizer.pre_tokenize_str(text)]


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text.  Plain texts are looked up by white-space word (a
    pre-token never holds white space), others by pre-token."""
    merges, known = _counter(path)
    special, _ = special_splitter(path)
    pattern, plain = _normal(path)
    out, words = [], []
    for t in texts:
        parts = special.split(t) if special is not None else [t]
        out.append(len(parts) - 1)
        if plain and len(parts) == 1 and PLAIN(t):
            words.append(t.split())
        else:
            words.append([w for p in parts for w in (p.split() if plain and PLAIN(p) else slow_words(p, path))])
    fresh = known.fresh(set(chain.from_iterable(words)))
    for at in range(0, len(fresh), 100_000):
        part = fresh[at:at + 100_000]
        split = [[w] if isinstance(w, bytes) else pattern.findall(w.lower()) for w in part]
        each = dict.fromkeys(chain.from_iterable(split))
        counts = merges.count([w if isinstance(w, bytes) else w.encode() for w in each]) if each else []
        get = dict(zip(each, map(int, counts), strict=True)).__getitem__
        known.update(zip(part, (sum(map(get, ws)) for ws in split), strict=True))
    get = known.__getitem__
    return [n + sum(map(get, ws)) for n, ws in zip(out, words, strict=True)]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether these exceed ``limit``."""
    path = path or public_path("word_bpe_49k.json")

    def run(batches):
        for rb in pieces(batches):
            col = rb.column(1)
            n = np.array(count_tokens(col.to_pylist(), path), np.int64)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(lengths(col)), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    counted = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
