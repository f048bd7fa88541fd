"""Benchmark decontamination with an FM-index per training shard.

Every task cuts its documents into shards of a bounded size.  A shard's words
become numbers (words that no test phrase has are 0); its suffix array gives
the Burrows-Wheeler transform, a wavelet matrix answers rank queries on it, and
all test phrases of the benchmark are searched backwards at once.  Occurrences
are located by walking to the nearest sampled suffix position, then merged into
removal spans.

A run of phrase words shorter than the shortest test phrase can't hold one and
is left out of the index; every other word stays.

Defined cases: NULL text has no words; an item without words has no phrase;
items that repeat count once by item_id (NULL is the id 'null'); an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD_TABLE, id_text, pieces, texts

WINDOW = 10
SAMPLE = 8               # every so many text positions are kept for locating
BLOCK_BYTES = 16 << 20   # benchmark text of one broadcast block


class Wavelet:
    """Wavelet matrix over non-negative integers: rank(c, i) for arrays."""

    def __init__(self, seq: np.ndarray, largest: int):
        self.levels = []
        for bit in reversed(range(max(1, int(largest).bit_length()))):
            ones = (seq >> bit) & 1
            before = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(seq) - int(before[-1])
            self.levels.append((bit, before, zeros))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, end = np.zeros(len(c), np.int64), i
        for bit, before, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            a, b = before[start], before[end]
            start = np.where(one, zeros + a, start - a)
            end = np.where(one, zeros + b, end - b)
        return end - start


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; zeros are separators, each smaller than any later one."""
    n = len(seq)
    zero = seq == 0
    key = np.where(zero, np.cumsum(zero) - 1, seq + int(zero.sum()))
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.full(n, 0, np.int64)
        second[:n - step] = rank[step:] + 1 if step < n else 0
        pair = rank * (n + 1) + second
        order = np.argsort(pair)
        fresh = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FmIndex:
    """``seq``: runs of positive integers, each ended by one 0."""

    def __init__(self, seq: np.ndarray):
        self.n, largest = len(seq), int(seq.max(initial=0))
        order = suffix_array(seq)
        self.last = seq[order - 1]                       # the transform
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=largest + 1))])
        self.wavelet = Wavelet(self.last, largest)
        starts = np.concatenate([[True], seq[:-1] == 0])  # a walk never crosses a separator
        kept = (order % SAMPLE == 0) | starts[order]
        self.sampled, self.kept_before = order[kept], np.concatenate([[0], np.cumsum(kept)])
        self.kept = kept

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each row of ``phrases``."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for c in phrases.T[::-1]:
            ok = (high > low) & (c < len(self.first) - 1)
            c = np.where(ok, c, 0)
            base = self.first[c]
            low, high = base + self.wavelet.rank(c, low), base + self.wavelet.rank(c, high)
            high = np.where(ok, high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = at[todo]
            done = self.kept[here]
            out[todo[done]] = self.sampled[self.kept_before[here[done]]] + steps[todo[done]]
            todo = todo[~done]
            here, c = at[todo], self.last[at[todo]]
            at[todo] = self.first[c] + self.wavelet.rank(c, here)
            steps[todo] += 1
        return out


def _block(rows) -> dict | None:
    """Test phrases of benchmark rows: word numbers, phrases by length, items of each phrase."""
    words: dict[bytes, int] = {}
    phrases: dict[tuple, set] = {}
    for item, text in rows:
        ids = [words.setdefault(w, len(words) + 1) for w in (text or "").encode().translate(WORD_TABLE).split()]
        for k in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
            phrases.setdefault(tuple(ids[k:k + WINDOW]), set()).add("null" if item is None else str(item))
    if not phrases:
        return None
    by_len: dict[int, list] = {}
    for p, items in phrases.items():
        by_len.setdefault(len(p), []).append((p, sorted(items)))
    return {"words": words, "least": min(by_len),
            "phrases": [(k, np.array([p for p, _ in v], np.int64), [i for _, i in v]) for k, v in sorted(by_len.items())]}


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list:
    """The benchmark as broadcast blocks of bounded size (``BLOCK_BYTES`` of
    text each), so that any number of items can be searched."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n, sc, out = max(1, -(-int(total) // BLOCK_BYTES)), benchmark.sparkSession.sparkContext, []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        if (block := _block(part.collect())) is not None:
            out.append(sc.broadcast(block))
    return out


def _hits(docs: list[list[bytes]], block: dict) -> tuple[list[np.ndarray], list[set]]:
    """For each document (as words): which words are hit, and the items found."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    hit, items = np.zeros(total, bool), [set() for _ in docs]
    get = block["words"].get
    ids = np.fromiter(map(get, chain.from_iterable(docs), repeat(0)), np.int64, total)
    # runs of phrase words within a document
    opens = np.zeros(total + 1, bool)
    opens[(ends - sizes)] = True
    known = ids > 0
    start = np.flatnonzero(known & (opens[:total] | ~np.concatenate([[False], known[:-1]])))
    stop = np.flatnonzero(known & (np.concatenate([opens[1:total], [True]]) | ~np.concatenate([known[1:], [False]]))) + 1
    long = stop - start >= block["least"]
    start, stop = start[long], stop[long]
    if not len(start):
        return np.split(hit, ends[:-1]), items
    size = stop - start
    first = np.cumsum(size + 1) - (size + 1)             # place of each run in the index
    seq = np.zeros(int(size.sum()) + len(size), np.int64)
    place = np.full(len(seq), -1, np.int64)              # word number of each index position
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    target, source = np.repeat(first, size) + inside, np.repeat(start, size) + inside
    seq[target], place[target] = ids[source], source
    index = FmIndex(seq)
    edge = np.zeros(total + 1, np.int64)
    doc_of = np.searchsorted(ends, place, "right")
    for k, phrases, owners in block["phrases"]:
        low, high = index.search(phrases)
        count = high - low
        if not count.any():
            continue
        which = np.repeat(np.arange(len(phrases)), count)
        rows = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        found = index.locate(rows)
        np.add.at(edge, place[found], 1)
        np.add.at(edge, place[found] + k, -1)
        for d, p in np.unique(np.stack([doc_of[found], which], 1), axis=0).tolist():
            items[d].update(owners[p])
    hit = np.cumsum(edge[:total]) > 0
    return np.split(hit, ends[:-1]), items


def _scan(raw: list[bytes], blocks: list) -> Iterator[tuple[int, np.ndarray, set]]:
    """(words, hit words, items) of each text."""
    docs = [t.translate(WORD_TABLE).split() for t in raw]
    hits, items = [np.zeros(len(d), bool) for d in docs], [set() for _ in docs]
    for b in blocks:
        h, i = _hits(docs, b.value)
        hits = [x | y for x, y in zip(hits, h, strict=True)]
        items = [x | y for x, y in zip(items, i, strict=True)]
        if len(blocks) > 1:
            del b._value                                 # one block in memory at a time
    return zip(docs, hits, items, strict=True)


def _spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans from the first to the last word of each run of hit words."""
    words = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_TABLE))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [(words[a][0], words[b - 1][1]) for a, b in zip(edge[::2], edge[1::2], strict=True)]


RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>, text string"


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       keep_text: bool = False) -> DataFrame:
    """One row per document: words, hit words, found items (sorted as strings)
    and the merged removal spans as byte ranges of the UTF-8 text; with
    ``keep_text`` also the text without those spans."""
    blocks = benchmark_blocks(benchmark)

    def run(batches):
        for rb in pieces(batches):
            raw, rows = texts(rb), []
            for t, (words, hit, items) in zip(raw, _scan(raw, blocks), strict=True):
                n, spans, left = int(hit.sum()), [], None
                if n:
                    spans = _spans(t, hit)
                if keep_text:
                    edges = [0, *chain.from_iterable(spans), len(t)]
                    left = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "replace")
                rows.append((len(words), n, sorted(items), [{"start": a, "stop": b} for a, b in spans], left))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), *(pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.int64(), pa.list_(pa.string()),
                    pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()), strict=True))],
                ["doc_id", "n_words", "n_hit", "items", "spans", "text"])

    return id_text(docs, id_col, text_col).mapInArrow(run, RESULT)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every removal span cut out of the text (``length_col``,
    where there is one, follows); a document of which no word is left is
    dropped, clean documents stay byte for byte."""
    blocks = benchmark_blocks(benchmark)
    schema, names = docs.schema, docs.columns
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches):
        for rb in pieces(batches, text_col):
            raw = [t or b"" for t in texts(rb, text_col)]
            new, size, keep = [], [], []
            for t, (words, hit, _) in zip(raw, _scan(raw, blocks), strict=True):
                n = int(hit.sum())
                edges = [0, *chain.from_iterable(_spans(t, hit) if n else []), len(t)]
                left = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
                new.append(left if n else None)
                size.append(len(left))
                keep.append(n < len(words) or not n)
            cut = [x is not None for x in new]
            if any(cut):
                old = rb.column(at)
                cols = list(rb.columns)
                cols[at] = pa.array([x if x is not None else o for x, o in zip(new, old.to_pylist(), strict=True)], old.type)
                if length_at is not None:
                    o = cols[length_at]
                    cols[length_at] = pa.array([s if c else v for s, c, v in zip(size, cut, o.to_pylist(), strict=True)], o.type)
                rb = pa.RecordBatch.from_arrays(cols, schema=rb.schema).filter(pa.array(keep))
            yield rb

    return docs.mapInArrow(run, schema)


def items_digest(items) -> F.Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The registered digest of ``find_contamination``."""
    found = find_contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


__all__ = ["FmIndex", "Wavelet", "benchmark_blocks", "find_contamination", "query", "remove_contamination"]
