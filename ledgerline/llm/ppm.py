"""Language-model scoring by prediction by partial matching (PPM).

The training documents' bytes (A-Z lower-cased, one end symbol per text) give
counts of every symbol after every context of up to ``order`` bytes.  The
probability of a symbol is that of PPM with method C escapes and full symbol
exclusion: from the longest trained context to the shortest, then evenly over
the symbols left.

The counts of all contexts are Spark tables, one per length, and grow with the
input.  They hold every (context, symbol) of the corpus, those that only stand
in held-out texts with a count of 0.  A symbol seen after a context is also
seen after the context's suffix, so what an escape excludes is exactly what
the longer context has seen, and the probability of a row follows from the row
of its suffix and a few sums over its own context.

Documents are dealt to chunks of a bounded size by hash.  A chunk's distinct
(context, symbol) codes and distinct words are counted and looked up once per
chunk, so a very common one costs a row per chunk.  The words make a smoothed
unigram model that stands beside the other.

With ``max_contexts`` only the most frequent contexts are kept, in a trie that
every task holds (a context's suffix is at least as frequent, so the trie
stays closed); the registered query doesn't use it.

Defined cases: a NULL text is empty (one end symbol, one end token); a NULL id
is trained on; without training documents all symbols are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, id_text, pieces, stash, texts

END = 256                      # symbol after the last byte of a text
SYMBOLS = 257
CHUNK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20          # texts whose symbols are handled at a time (one text at least)
SLICE_BITS = 20                # and at most so many bits to number them
SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))


@dataclass(frozen=True)
class PpmParams:
    order: int = 4
    max_contexts: int | None = None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _symbols(raw: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' symbols, ``order`` zeros before each; the places of the
    symbols that count, and the first of these for each text."""
    pad = bytes(order)
    joined = np.frombuffer(b"".join(pad + t + b"\0" for t in raw), np.uint8).astype(np.int16)
    size = np.array([len(t) for t in raw], np.int64) + 1
    ends = np.cumsum(size + order)
    joined[ends - 1] = END
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) + order * (1 + np.repeat(np.arange(len(raw)), size))
    return joined, place, first


def context_counts(docs: DataFrame, order: int) -> DataFrame:
    """(context, symbol, n): the context's bytes as a number, last byte lowest.
    Counted per task, then summed by Spark."""

    def run(batches):
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rb in pieces(batches):
            x, place, _ = _symbols([t.translate(LOWER) for t in texts(rb)], order)
            context = np.zeros(len(place), np.int64)
            for k in range(order, 0, -1):
                context = context << 8 | x[place - k]
            new, n = np.unique(context << 9 | x[place], return_counts=True)
            codes, where = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        for at in range(0, len(codes), 100_000):
            part = codes[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part >> 9), pa.array((part & 511).astype(np.int32)), pa.array(counts[at:at + 100_000])],
                                             ["context", "symbol", "n"])

    found = docs.select("text").mapInArrow(run, "context long, symbol int, n long")
    return found.groupBy("context", "symbol").agg(F.sum("n").alias("n"))


class Model:
    """Dense tables over the kept contexts: ``child`` (longer context by the
    byte before) and ``logp`` (natural logarithm of each symbol)."""

    def __init__(self, order: int, level: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        """Parallel arrays of counts; every kept context with all its symbols, level 0 is the root."""
        self.order = order
        seen = np.unique(symbol)
        # columns: symbols of the training texts, and all bytes of contexts; the last column is any other symbol
        self.column = np.full(SYMBOLS, len(seen), np.int64)
        self.column[seen] = np.arange(len(seen))
        width = len(seen) + 1
        nodes, row = np.unique(level.astype(np.int64) << 48 | context, return_inverse=True)
        if not len(nodes) or nodes[0] != 0:
            nodes = np.concatenate([[0], nodes])
            row = row + 1
        counts = np.zeros((len(nodes), width))
        counts[row, self.column[symbol]] = n
        levels, contexts = nodes >> 48, nodes & ((1 << 48) - 1)
        suffix = np.zeros(len(nodes), np.int64)           # the context without its first byte
        self.child = np.zeros((len(nodes), 256), np.int32)
        for k in range(1, order + 1):
            mine = np.flatnonzero(levels == k)
            shorter = (np.int64(k - 1) << 48) | (contexts[mine] & ((1 << (8 * (k - 1))) - 1))
            at = np.minimum(np.searchsorted(nodes, shorter), len(nodes) - 1)
            if not (nodes[at] == shorter).all():
                raise ValueError("the trie is not closed under suffixes")
            suffix[mine] = at
            self.child[at, contexts[mine] >> (8 * (k - 1))] = mine
        self.logp = np.empty((len(nodes), width), np.float32)
        for k in range(order + 1):
            mine = np.flatnonzero(levels == k)
            for at in range(0, len(mine), 4096):
                self.logp[mine[at:at + 4096]] = self._settle(counts, suffix, mine[at:at + 4096], k, len(seen))

    @staticmethod
    def _settle(counts: np.ndarray, suffix: np.ndarray, rows: np.ndarray, level: int, seen: int) -> np.ndarray:
        out = np.zeros((len(rows), counts.shape[1]))
        excluded = np.zeros(out.shape, bool)
        escape = np.zeros(len(rows))
        node = rows
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(level + 1):
                c = np.where(excluded, 0, counts[node])
                some = c > 0
                total, kinds = c.sum(1), some.sum(1)
                left = SYMBOLS - excluded.sum(1) - kinds  # symbols that an escape may lead to
                base = total + np.where(left > 0, kinds, 0)
                out = np.where(some, escape[:, None] + np.log(c / base[:, None]), out)
                escape = escape + np.where((kinds > 0) & (left > 0), np.log(kinds / base), 0)
                excluded |= some
                node = suffix[node]
            left = SYMBOLS - excluded.sum(1)
            rest = escape - np.log(np.maximum(left, 1))
        return np.where(excluded, out, rest[:, None]).astype(np.float32)

    def score(self, raw: list[bytes]) -> np.ndarray:
        """Natural log probability of each (lower-cased) text with its end."""
        if not raw:
            return np.zeros(0)
        x, place, first = _symbols(raw, self.order)
        node = np.zeros(len(place), np.int32)
        live = np.ones(len(place), bool)
        for k in range(1, self.order + 1):
            down = self.child[node, x[place - k]]
            live &= down > 0
            node = np.where(live, down, node)
        return np.add.reduceat(self.logp[node, self.column[x[place]]].astype(np.float64), first)


def train(docs: DataFrame, params: PpmParams = PpmParams()) -> Model:
    """The model of all texts in ``docs`` (column text, no NULLs)."""
    grams = stash(context_counts(docs, params.order), "ppm-counts")
    levels = grams.select(F.explode(F.sequence(F.lit(0), F.lit(params.order))).alias("level"), "context", "symbol", "n")
    masks = F.array(*[F.lit((1 << 8 * k) - 1).cast("long") for k in range(params.order + 1)])
    cut = F.col("context").bitwiseAND(F.get(masks, F.col("level")))
    counts = stash(levels.select("level", cut.alias("context"), "symbol", "n").groupBy("level", "context", "symbol")
                   .agg(F.sum("n").alias("n")), "ppm-levels")
    totals = counts.where("level > 0").groupBy("level", "context").agg(F.sum("n").alias("total"))
    kept = totals.orderBy(F.col("total").desc(), "level", "context").limit(params.max_contexts).select("level", "context")
    # at most (max_contexts + 1) * 257 counts
    rows = counts.join(F.broadcast(kept), ["level", "context"]).unionByName(counts.where("level = 0")).toArrow()
    col = {c: rows.column(c).to_numpy() for c in ("level", "context", "symbol", "n")}
    return Model(params.order, col["level"], col["context"], col["symbol"], col["n"])


def _words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For every word of the texts: its place among the sorted distinct words
    and the text it stands in; and the distinct words after b'' (the end
    token, place 0)."""
    joined = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    inside = ~SPACE[joined]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    size = np.array([len(t) + 1 for t in raw], np.int64)
    owner = np.searchsorted(np.cumsum(size), edge[::2] - 1, "right")
    offsets = np.append(0, np.cumsum(edge[1::2] - edge[::2]))
    words = pa.Array.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])]).dictionary_encode()
    order = pc.sort_indices(words.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(1, len(order) + 1)
    distinct = pa.concat_arrays([pa.array([b""], pa.binary()), words.dictionary.take(order).cast(pa.binary())])
    return place[words.indices.to_numpy()], owner, distinct


def _codes(raw: list[bytes], order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the texts: first and last text, the code (context, then
    symbol) of every place, and the text of each place, counted in the slice.
    The bits above a code can hold that number."""
    ends = np.cumsum([len(t) for t in raw])
    at, most = 0, 1 << min(SLICE_BITS, 54 - 8 * order)
    while at < len(raw):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        stop = min(stop, at + most)
        x, place, first = _symbols(raw[at:stop], order)
        code = np.zeros(len(place), np.int64)
        for k in range(order, 0, -1):
            code = code << 8 | x[place - k]
        yield at, stop, code << 9 | x[place], np.repeat(np.arange(stop - at), np.diff(np.append(first, len(place))))
        at = stop


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the length at the end."""
    return np.append(np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])), len(ordered)) if len(ordered) else np.zeros(1, np.int64)


def _distinct_codes(raw: list[bytes], held: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct codes in order, and their counts in the training texts."""
    found, counts = [np.zeros(0, np.int64)], [np.zeros(0)]
    for at, stop, code, owner in _codes(raw, order):
        code = code << 1 | held[at:stop][owner]
        code.sort()
        run = _runs(code)
        code = code[run[:-1]]
        found.append(code >> 1)
        counts.append(np.diff(run) * (1 - (code & 1)))
    codes, where = np.unique(np.concatenate(found), return_inverse=True)
    return codes, np.bincount(where, np.concatenate(counts), len(codes)).astype(np.int64)


def _ppm_scores(raw: list[bytes], order: int, codes: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Natural log probability of each text, from the sorted codes and theirs."""
    out = [np.zeros(0)]
    for at, stop, code, owner in _codes(raw, order):
        bits = (stop - at).bit_length()
        code = code << bits | owner                      # in the order of the codes, their lookup is local
        code.sort()
        owner = code & ((1 << bits) - 1)
        code >>= bits
        run = _runs(code)
        each = logp[np.searchsorted(codes, code[run[:-1]])]
        out.append(np.bincount(owner, np.repeat(each, np.diff(run)), stop - at))
    return np.concatenate(out)


def chunk_counts(chunked: DataFrame, order: int | None) -> DataFrame:
    """(chunk, place, word, code, n) for every distinct word, then every
    distinct code (none without an order) of every chunk: its place among the
    chunk's sorted words or codes, its count in the chunk's training documents."""

    def run(table: pa.Table) -> pa.Table:
        raw = [t.translate(LOWER) for t in table.column("text").cast(pa.binary()).to_pylist()]
        held = table.column("held_out").to_numpy().astype(np.int64)
        ids, owner, words = _words(raw)
        n = np.bincount(ids, 1 - held[owner], len(words)).astype(np.int64)
        n[0] = len(raw) - held.sum()
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if order is not None:
            codes, counts = _distinct_codes(raw, held, order)
        chunk = table.column("chunk")[0].as_py()
        rows = len(words) + len(codes)
        return pa.table({"chunk": pa.array(np.full(rows, chunk, np.int64)),
                         "place": pa.array(np.concatenate([np.arange(len(words)), np.arange(len(codes))]).astype(np.int32)),
                         "word": pa.chunked_array([words, pa.nulls(len(codes), pa.binary())]).combine_chunks(),
                         "code": pa.chunked_array([pa.nulls(len(words), pa.int64()), pa.array(codes)]).combine_chunks(),
                         "n": pa.array(np.concatenate([n, counts]))})

    return stash(chunked.groupBy("chunk").applyInArrow(run, "chunk long, place int, word binary, code long, n long"), "ppm-chunks")


def word_counts(found: DataFrame) -> DataFrame:
    """(chunk, place, c, lead): the count of each chunk's words in all
    training documents; lead marks one row of each word."""
    w = Window.partitionBy("word")
    counted = found.where("word IS NOT NULL").select(
        "chunk", "place", F.sum("n").over(w).alias("c"), (F.min("chunk").over(w) == F.col("chunk")).alias("lead"))
    return stash(counted, "ppm-words")


def settled(found: DataFrame, order: int) -> DataFrame:
    """(code, logp): natural logarithm of the probability of every code in ``found``.

    Level by level from the empty context.  Of each (context, symbol) row:
    n its count; total and kinds the sum and number of its context's symbols
    with a count; logp the symbol's probability after the context; past, for
    n = 0, its probability once the context has been escaped from."""
    counts = {order: stash(found.where("code IS NOT NULL").groupBy((F.shiftright("code", 9)).alias("context"), F.col("code").bitwiseAND(511).cast("int").alias("symbol"))
                           .agg(F.sum("n").alias("n")), "ppm-counts")}
    for k in range(order - 1, -1, -1):
        suffix = F.col("context").bitwiseAND(F.lit((1 << 8 * k) - 1))
        counts[k] = stash(counts[k + 1].groupBy(suffix.alias("context"), "symbol").agg(F.sum("n").alias("n")), "ppm-counts")
    w, n, total, kinds = Window.partitionBy("context"), F.col("n"), F.col("total"), F.col("kinds")
    sums = [F.sum("n").over(w).alias("total"), F.sum((n > 0).cast("long")).over(w).alias("kinds")]
    seen = F.log(n / (total + F.when(kinds < SYMBOLS, kinds).otherwise(0)))
    escape = F.log(kinds / (total + kinds))
    past = -F.log(F.lit(SYMBOLS) - kinds)
    row = ["context", "symbol", "n", "total", "kinds"]
    done = counts[0].select("context", "symbol", "n", *sums)
    done = done.select(*row, F.when(kinds == 0, -F.log(F.lit(float(SYMBOLS)))).when(n > 0, seen).otherwise(escape + past).alias("logp"), past.alias("past"))
    for k in range(1, order + 1):
        shorter = stash(done, "ppm-settled").select(*[F.col(c).alias(f"s_{c}") for c in done.columns])
        suffix = F.col("context").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
        joined = counts[k].join(shorter, (suffix == F.col("s_context")) & (F.col("symbol") == F.col("s_symbol")))
        # what the context has seen is excluded from its suffix's symbols
        joined = joined.select("*", *sums, F.sum(F.when(n > 0, F.col("s_n")).otherwise(0)).over(w).alias("excluded"))
        open_ = F.col("s_kinds") < SYMBOLS
        base = F.col("s_total") - F.col("excluded") + F.when(open_, F.col("s_kinds") - kinds).otherwise(0)
        on = F.when(open_ & (F.col("s_kinds") > kinds), F.log((F.col("s_kinds") - kinds) / base)).otherwise(0.0)
        past = F.when(F.col("s_n") > 0, F.log(F.col("s_n") / base)).otherwise(on + F.col("s_past"))
        # past has a meaning only for symbols that the context hasn't seen
        joined = joined.withColumn("past", F.when(n == 0, past))
        done = joined.select(*row, F.when(kinds == 0, F.col("s_logp")).when(n > 0, seen).otherwise(escape + F.col("past")).alias("logp"), "past")
    return stash(done.select(F.shiftleft("context", 9).bitwiseOR(F.col("symbol").cast("long")).alias("code"), "logp"), "ppm-settled")


def score(docs: DataFrame, params: PpmParams = PpmParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probability by the PPM model), n_bytes."""
    named = id_text(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-int(size) // CHUNK_BYTES))
    chunked = named.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long"))
    whole, model = params.max_contexts is None, None
    if not whole:
        model = docs.sparkSession.sparkContext.broadcast(train(named.where(~F.col("held_out")), params))
    found = chunk_counts(chunked, params.order if whole else None)
    words = word_counts(found)
    n, v = words.where("lead").agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n, v = int(n or 0), int(v or 0)
    looked_up = words.select("chunk", F.col("place").cast("long").alias("place"), "c", F.lit(None).cast("double").alias("logp"))
    if whole:
        looked_up = looked_up.unionByName(found.where("code IS NOT NULL").select("chunk", "code").join(settled(found, params.order), "code")
                                          .select("chunk", F.col("code").alias("place"), F.lit(None).cast("long").alias("c"), "logp"))

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        raw = [t.translate(LOWER) for t in docs.column("text").cast(pa.binary()).to_pylist()]
        ids, owner, distinct = _words(raw)
        words = found.filter(pc.is_valid(found.column("c")))
        c = np.zeros(len(distinct), np.int64)
        c[words.column("place").to_numpy()] = words.column("c").to_numpy()
        logs = np.log10((c + 1.0) / (n + (v + 1)))
        tokens = np.bincount(owner, minlength=len(raw)) + 1
        known = np.bincount(owner, c[ids] > 0, len(raw)).astype(np.int64) + int(c[0] > 0)
        base = np.bincount(owner, logs[ids], len(raw)) + logs[0]
        if whole:
            coded = found.filter(pc.is_valid(found.column("logp")))
            codes, logp = coded.column("place").to_numpy(), coded.column("logp").to_numpy()
            by = np.argsort(codes)
            ppm = _ppm_scores(raw, params.order, codes[by], logp[by])
        else:
            ppm = np.concatenate([model.value.score(raw[k:k + 256]) for k in range(0, len(raw), 256)])
        return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "held_out": docs.column("held_out"),
                         "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
                         "train_tokens": pa.array([n] * len(raw), pa.int64()), "base_score": pa.array(base, pa.float64()),
                         "score": pa.array(ppm / np.log(10), pa.float64()), "n_bytes": pa.array([len(t) for t in raw], pa.int64())})

    return chunked.groupBy("chunk").cogroup(looked_up.groupBy("chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def query(docs: DataFrame) -> DataFrame:
    return score(docs).drop("n_bytes")
