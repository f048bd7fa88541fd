"""Spelling variants by a trie of letter-group counts.

Words at one inserted, deleted or replaced code point have counts of letters
that differ by a surplus of at most one and a deficit of at most one.  Words
are therefore arranged by successive counts: how many of their code points
fall into each of ``COARSE`` ranges of letter groups, then into each of
``GROUPS`` groups.  The trie's first levels deal the words to tasks; a task
sorts its words by the counts, so that a node of the trie is a range of rows,
and searches depth first, carrying at each node the asking words that can
still afford it.  Small nodes are leaves, whose words are verified.

A word is asked for in every first-level node it can reach, as the shorter or
(with the same length) the smaller word of a pair, so that each pair is found
once.  A node of many words is cut into blocks, its asking words likewise, and
each pair of blocks is a task of bounded memory.

Defined cases: a NULL text has no words; a NULL id is written as the empty
text before the colon; rows that repeat count as often as they occur; a run
whose deletion leaves nothing is no word; empty tables give no rows.
"""

from __future__ import annotations

from array import array
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import pieces, stash

# letters in Latin-1, A-Z lower-cased; all else is a blank
RUN_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))
NOISE = 199
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
COARSE, GROUPS = 3, 26    # letter groups by code point modulo GROUPS; COARSE ranges of them
BLOCK = 50_000            # words of one task
LEAF = 128                # words of a node that are compared at once
WIDE = 40                 # code points up to which pairs are verified as rows of a matrix
HELD = 500_000            # distinct words that a task counts before it passes them on ...
HELD_BYTES = 64 << 20     # ... or so many bytes of them
SHORT = 48                # bytes of a run up to which checksums are combined in bulk


def noisy(word: str, h: int) -> str:
    """The run without the code point that its checksum names, if it names one."""
    if h % NOISE:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def _utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what n more bytes make of a checksum's k-th byte b.  A checksum
    is linear: crc(x + y) = shift(crc(x), len(y)) ^ crc(y)."""
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for n in range(SHORT + 1):
        zeros = bytes(n)
        none = crc32(zeros)
        bits = [crc32(zeros, 1 << bit) ^ none for bit in range(32)]
        for k in range(4):
            for bit in range(8):
                out[n, k, 1 << bit:2 << bit] = out[n, k, :1 << bit] ^ bits[8 * k + bit]
    return out


class _Runs(dict):
    """Numbers of a task's distinct runs, with their checksums and lengths."""

    def __init__(self):
        self.crc, self.size, self.held = array("I"), array("I"), 0

    def __missing__(self, run: bytes) -> int:
        written = _utf8(run)
        self[run] = k = len(self)
        self.crc.append(crc32(written))
        self.size.append(min(len(written), SHORT + 1))
        self.held += len(run)
        return k


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 1) -> DataFrame:
    """(word, n) of all runs, lower-cased and with the planted deletions, that
    have at least ``letters`` code points.

    A task numbers its distinct runs; the checksums of id and run are combined
    from those of both for a batch at once, and only runs that lose a code
    point (or have over ``SHORT`` bytes) are looked at one by one."""

    def run(batches):
        shift = _shift_tables()
        known, counts, lost = _Runs(), np.zeros(1 << 16, np.int64), Counter()

        def flush():
            words = [w.decode("latin-1") for w in known]
            n = counts[:len(words)].tolist()
            kept = [k for k, w in enumerate(words) if n[k] and len(w) >= letters]
            found = [(w, m) for w, m in lost.items() if len(w) >= letters]
            return pa.RecordBatch.from_arrays([pa.array([words[k] for k in kept] + [w for w, _ in found], pa.string()),
                                               pa.array([n[k] for k in kept] + [m for _, m in found], pa.int64())], ["word", "n"])

        for rb in pieces(batches):
            starts, sizes, met = [], [], array("I")
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                # code points over FF become '?', no letter either
                runs = text.encode("latin-1", "replace").translate(RUN_BYTES).split()
                starts.append(crc32(f"{'' if doc_id is None else doc_id}:".encode()))
                sizes.append(len(runs))
                met.extend(map(known.__getitem__, runs))
            ids = np.frombuffer(met, np.uint32)
            x, doc = np.array(starts, np.uint32), np.repeat(np.arange(len(starts)), sizes)
            moved = np.zeros((len(x), SHORT + 1), np.uint32)
            for k in range(4):
                moved ^= shift[:, k, (x >> np.uint32(8 * k)) & np.uint32(255)].T
            size = np.frombuffer(known.size, np.uint32)[ids]
            long = size > SHORT
            h = np.frombuffer(known.crc, np.uint32)[ids] ^ moved[doc, np.minimum(size, SHORT)]
            alone = (h % np.uint32(NOISE) == 0) | long
            if len(counts) < len(known):
                counts = np.concatenate((counts, np.zeros(2 * len(known) - len(counts), np.int64)))
            counts[:len(known)] += np.bincount(ids[~alone], minlength=len(known))
            if alone.any():
                names = list(known)
                for k in np.flatnonzero(alone).tolist():
                    word = names[ids[k]]
                    lost[noisy(word.decode("latin-1"), crc32(_utf8(word), starts[doc[k]]))] += 1
            if len(known) >= HELD or known.held >= HELD_BYTES:
                yield flush()
                known, counts, lost = _Runs(), np.zeros(1 << 16, np.int64), Counter()
        yield flush()

    clean = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return clean.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("word <> ''")


def _coarse(word: Column) -> list[Column]:
    """Counts of the word's code points in the coarse ranges of letter groups."""
    every = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
    out = []
    for k in range(COARSE):
        own = "".join(chr(c) for c in every if c % GROUPS * COARSE // GROUPS == k)
        out.append(F.length(word) - F.length(F.translate(word, own, "")))
    return out


def _steps() -> list[list[int]]:
    """What the coarse counts of the longer (or equally long) word of a pair may have more."""
    unit = np.eye(COARSE, dtype=int)
    return [[0] * COARSE, *(unit[i].tolist() for i in range(COARSE)), *((unit[i] - unit[j]).tolist() for i in range(COARSE) for j in range(COARSE) if i != j)]


def _levels(codes: list[bytes]) -> np.ndarray:
    """Counts of every word by letter group, the levels of a task's trie (its
    words have their coarse counts in common)."""
    size = np.fromiter(map(len, codes), np.int64, len(codes))
    group = np.frombuffer(b"".join(codes), np.uint8).astype(np.int64) % GROUPS
    row = np.repeat(np.arange(len(codes)), size)
    out = np.bincount(row * GROUPS + group, minlength=len(codes) * GROUPS).reshape(len(codes), GROUPS)
    return out.astype(np.int8 if not len(out) or out.max() < 60 else np.int32)


def _marks(levels: np.ndarray) -> np.ndarray:
    """64 bits of a word's counts (at least 1, at least 2, the first groups'
    at least 3): each surplus or deficit of one changes one bit at most."""
    seen = np.concatenate((levels >= 1, levels >= 2, levels[:, :64 - 2 * GROUPS] >= 3), axis=1)
    return np.ascontiguousarray(np.packbits(seen, axis=1, bitorder="little")).view(np.uint64)[:, 0]


def one_edit(a: bytes, b: bytes) -> bool:
    """b is a with one code point replaced or inserted (len(a) <= len(b))."""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1:] == b[i + 1:] if len(a) == len(b) else len(a) + 1 == len(b) and a[i:] == b[i + 1:])


def _matrix(codes: list[bytes]) -> np.ndarray:
    """The words' code points, a row each, cut at WIDE and padded with zeros."""
    size = np.minimum(np.fromiter(map(len, codes), np.int64, len(codes)), WIDE)
    out = np.zeros((len(codes), int(size.max()) + 2), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(w[:WIDE] for w in codes), np.uint8)
    return out


def _verified(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """``one_edit`` for rows of two matrices of the same width, and the words in
    order where they have the same length."""
    same, rows = a == b, np.arange(len(a))
    first = same.argmin(1)
    moved = (a[:, :-1] == b[:, 1:]) | (np.arange(a.shape[1] - 1) < first[:, None])
    return np.where(longer, moved.all(1), (same.sum(1) == a.shape[1] - 1) & (a[rows, first] < b[rows, first]))


def near_pairs(asks: list[bytes], words: list[bytes]) -> list[tuple[int, int]]:
    """(i, j) with words[j] one edit from asks[i] and longer, or of the same
    length and greater, by a depth-first search of the trie of ``words``."""
    q, m = _levels(asks), _levels(words)
    found: list[tuple[int, int]] = []
    if not len(q) or not len(m):
        return found
    first = np.argsort(-m.std(0), kind="stable")              # groups that tell most words apart come first
    q, m = q[:, first], m[:, first]
    order = np.lexsort(m.T[::-1])
    m = m[order]
    q_marks, m_marks = _marks(q), _marks(m)
    codes = _matrix(asks + words)
    q_codes, m_codes = codes[:len(asks)], codes[len(asks):]
    q_size, m_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (asks, words))
    none = np.zeros(len(q), np.int8)
    stack = [(0, len(m), 0, np.arange(len(q)), none, none)]
    while stack:
        lo, hi, level, ask, surplus, deficit = stack.pop()
        if hi - lo <= LEAF or level == GROUPS:
            for at in range(0, len(ask), 4096):
                own = ask[at:at + 4096]
                i, j = np.nonzero(np.bitwise_count(q_marks[own, None] ^ m_marks[None, lo:hi]) <= 2)
                i, j = own[i], j + lo
                d = m[j].astype(np.int32) - q[i]
                more, less = np.maximum(d, 0).sum(1), np.maximum(-d, 0).sum(1)
                fits = (more <= 1) & (less <= more)
                i, j = i[fits], order[j[fits]]
                short = np.maximum(q_size[i], m_size[j]) <= WIDE
                good = np.zeros(len(i), bool)
                good[short] = _verified(q_codes[i[short]], m_codes[j[short]], q_size[i[short]] < m_size[j[short]])
                for k in np.flatnonzero(~short).tolist():
                    x, y = asks[i[k]], words[j[k]]
                    good[k] = (len(x) < len(y) or x < y) and one_edit(x, y)
                found += zip(i[good].tolist(), j[good].tolist(), strict=True)
            continue
        column = m[lo:hi, level]
        cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), hi - lo]
        mine = q[ask, level]
        for a, b in zip(cuts, cuts[1:], strict=False):
            d = column[a] - mine
            more, less = surplus + np.maximum(d, 0), deficit + np.maximum(-d, 0)
            keep = (more <= 1) & (less <= 1)
            if keep.any():
                stack.append((lo + a, lo + b, level + 1, ask[keep], more[keep], less[keep]))
    return found


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per word that has near words here: their number and the best."""
    asked, held = pdf[pdf.asks].reset_index(drop=True), pdf[~pdf.asks].reset_index(drop=True)
    pairs = near_pairs([w.encode("latin-1") for w in asked.word], [w.encode("latin-1") for w in held.word])
    best: dict[str, list] = {}
    for i, j in pairs:
        x, y = (asked.word[i], int(asked.n[i])), (held.word[j], int(held.n[j]))
        for (word, _), (near, n) in ((x, y), (y, x)):
            was = best.setdefault(word, [0, 0, ""])
            was[0] += 1
            if (-n, near) < (-was[1], was[2]):
                was[1:] = n, near
    return pd.DataFrame([(w, *x) for w, x in best.items()], columns=["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of every word (word, n) that has near
    words: their number, the largest n and the first word with it."""
    shard = [f"s{k}" for k in range(COARSE)]
    dealt = stash(words.select("word", "n", *(c.cast("int").alias(s) for c, s in zip(_coarse(F.col("word")), shard, strict=True))), "spelling-words")
    steps = F.explode(F.array(*[F.struct(*[F.lit(x).alias(s) for x, s in zip(step, shard, strict=True)]) for step in _steps()]))
    asks = dealt.withColumn("step", steps).select("word", "n", *((F.col(s) + F.col(f"step.{s}")).alias(s) for s in shard))
    held = dealt.groupBy(*shard).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = asks.groupBy(*shard).agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("parts"))
    grid = stash(held.join(asked, shard), "spelling-grid")
    h = F.xxhash64("word")
    own = dealt.join(grid, shard).select(*shard, "word", "n", F.lit(False).alias("asks"), F.pmod(h, "blocks").cast("int").alias("block"),
                                         F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    ask = asks.join(grid, shard).select(*shard, "word", "n", F.lit(True).alias("asks"),
                                        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                        F.pmod(h, "parts").cast("int").alias("part"))
    found = own.unionByName(ask.select(own.columns)).groupBy(*shard, "block", "part").applyInPandas(
        _search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.order")).alias("near_n"), F.col("b.near").alias("near"))


def variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least
    ``letters`` code points and ``occurrences`` occurrences."""
    words = stash(word_counts(docs, id_col, text_col, letters).where((F.length("word") >= letters) & (F.col("n") >= occurrences)), "spelling-counts")
    table = words.join(near_words(words), "word", "left")
    has = F.col("near_n") >= ratio * F.col("n")
    table = stash(table.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near")).alias("form"),
                               F.when(has, F.col("near_n")).alias("form_n")), "spelling-forms")
    # a form's n is larger, so the chains end; each round doubles the steps made
    roots = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = stash(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = on.select("word", "root")
        if on.where("moved").isEmpty():
            break
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return variants(docs)
