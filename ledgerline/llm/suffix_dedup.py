"""Removal of byte strings that repeat, by suffix arrays of candidate shards.

Two equal ``width``-byte windows have equal minimizers (the smallest hash of
the 48-byte strings inside), so the windows of a text are cut into runs of one
minimizer.  Only runs whose minimizer occurs in another run can hold a repeat.
Which do is told by a bitmap of the repeated minimizers: its size is bounded,
its false positives only cost work, and if there are too many minimizers for
one bitmap they are taken in parts, each with a bitmap of its own.

The candidate runs (their windows' bytes) are dealt out by minimizer.  A task
cuts its rows into shards at minimizer boundaries and sorts each by induction
(``induced_sort``); neighbours in the suffix array that share ``width`` bytes
are repeats.  The repeats of a run go back to all its occurrences, are joined
to removal spans per document, and the documents are cut.

A run that occurs often travels to its shard at most twice per task.  A
minimizer with very many different runs is split further by the minimizer of
``width`` - 8 bytes, so that it doesn't end in one task.

Defined cases: a NULL text is empty; rows that repeat are documents of their
own, so their windows repeat; texts shorter than ``width`` lose nothing; what
is left may end inside a character and is kept as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import id_text, pieces, stash, texts
from ledgerline.llm.induced_sort import Shard

GRAM = 48
RUN = 2048                 # windows of one run at most
PIECE = 128 << 10          # bytes hashed at a time; the arrays (8 times that each) stay in a core's cache
SHARD = 4 << 20            # bytes of a shard that isn't a single minimizer's
BITS = 1 << 30             # bits of a bitmap at most
HOT = 20_000               # different runs of a minimizer beyond which it is split
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53,
       0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram``-byte string, from those of its halves."""
    def finish(x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(31))
        x *= np.uint64(MIX[4])
        return x ^ (x >> np.uint64(29))

    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[0])
    h ^= h >> np.uint64(32)
    have, out = 1, None
    for k in range(gram.bit_length()):
        if gram >> k & 1:                                  # the binary parts of the length, longest last
            out = h if out is None else _pair(h, out, have, MIX[7], gram - (gram >> k << k))
        if gram >> (k + 1):
            h = _pair(h, h, have, MIX[1 + k % 6], have)
            have *= 2
    return finish(out)


def _pair(a: np.ndarray, b: np.ndarray, length: int, factor: int, length_b: int) -> np.ndarray:
    """Hash of the string of a (``length`` bytes) followed by that of b."""
    n = len(a) - length_b
    x = a[:n] * np.uint64(factor) + b[length:length + n]
    x ^= x >> np.uint64(33)
    return x


def runs(data: np.ndarray, ends: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows, places) of each run of windows in
    the texts that end at ``ends`` (positions in ``data``); places: how often
    the minimizer stands in the run.  Equal windows of one run need two."""
    n = len(data) - width + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    hashes = gram_hashes(data, gram)
    low, have, want = hashes, 1, width - gram + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    key = low[:n]
    at = np.arange(n)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, np.int64)                     # windows that don't cross the end of a text
    long = ends - starts >= width
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - width + 1, -1)
    inside = np.cumsum(inside[:n]) > 0
    fresh = np.ones(n, bool)
    fresh[1:] = (key[1:] != key[:-1]) | ~inside[:-1]
    first_of_text = np.zeros(n, bool)
    first_of_text[starts[long]] = True
    fresh |= first_of_text
    # cut very long runs (periodic texts)
    begin = np.maximum.accumulate(np.where(fresh, at, 0))
    fresh |= (at - begin) % RUN == 0
    begin = np.flatnonzero(fresh & inside)
    stop = np.append(np.flatnonzero(fresh | ~inside), n)
    size = stop[np.searchsorted(stop, begin, "right")] - begin
    entered = np.concatenate([[0], np.cumsum(hashes[want - 1:want - 1 + n] == key)])
    places = entered[begin + size] - entered[begin + 1]
    window = np.lib.stride_tricks.sliding_window_view(hashes, want)
    for at in range(0, len(begin), 4096):
        b = begin[at:at + 4096]
        places[at:at + 4096] += (window[b] == key[b][:, None]).sum(1)
    return key[begin].view(np.int64), begin, size, places


def _layout(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw]).astype(np.int64)


def repeated_minimizers(named: DataFrame, width: int) -> DataFrame:
    """(key): minimizers that stand in two or more places; counted per piece, then by Spark."""

    def run(batches):
        for rb in pieces(batches, max_bytes=PIECE):
            key, _, _, places = runs(*_layout(texts(rb)), width)
            key, where = np.unique(key, return_inverse=True)
            n = np.bincount(where, places, len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return named.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of ``keys`` by their lowest bits: Spark joins 64 bits at a time,
    so at most ``bits`` / 64 rows reach the driver."""
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keys.select((F.shiftright(place, 6)).alias("w"), F.expr("shiftleft(1L, CAST(key & 63 AS INT))").alias("b")) \
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(max(1, bits >> 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint8)


def _digest(b: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(b, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


OCCURRENCE = "key long, h1 long, h2 long, doc_id long, dkey long, start long, n int, slice binary, again boolean"


def candidates(named: DataFrame, width: int, part: int, parts: int, bits: int, marks) -> DataFrame:
    """Every candidate run: its minimizer, digest and place; the bytes come
    with the first occurrence in a task, and the second is marked."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], bool] = {}
        table = marks.value
        for rb in pieces(batches, max_bytes=PIECE):
            raw = texts(rb)
            data, ends = _layout(raw)
            key, first, size, _ = runs(data, ends, width)
            place = key & (bits - 1)
            ok = (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
            if parts > 1:
                ok &= (key >> 40) % parts == part
            key, first, size = key[ok], first[ok], size[ok]
            doc = np.searchsorted(ends, first, "right")
            begin = np.concatenate([[0], ends])[doc]
            ids, dkeys = rb.column(0).take(pa.array(doc)), rb.column(2).take(pa.array(doc))
            joined = data.tobytes()
            h1, h2, slices, again = [], [], [], []
            for a, n in zip(first.tolist(), size.tolist(), strict=True):
                b = joined[a:a + n + width - 1]
                d = _digest(b)
                seen = met.get(d)
                slices.append(b if seen is None else None)
                again.append(seen is False)
                met[d] = seen is not None
                h1.append(d[0])
                h2.append(d[1])
            if len(met) > 500_000:
                met.clear()                                # bytes may then come twice, which is harmless
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), ids, dkeys, pa.array(first - begin),
                 pa.array(size.astype(np.int32)), pa.array(slices, pa.binary()), pa.array(again, pa.bool_())],
                ["key", "h1", "h2", "doc_id", "dkey", "start", "n", "slice", "again"])

    return named.mapInArrow(run, OCCURRENCE)


def repeats_in_shard(slices: list[bytes], width: int) -> list[np.ndarray]:
    """For each of the different byte strings: which of its windows occur twice."""
    sizes = np.array([len(b) for b in slices], np.int64) + 1
    ends = np.cumsum(sizes)
    text = np.ones(int(ends[-1]) + 1, np.uint16)
    text[-1] = 0
    body = np.ones(len(text), bool)
    body[ends - 1] = body[-1] = False
    text[body] = np.frombuffer(b"".join(slices), np.uint8).astype(np.uint16) + 2
    order, lcp = Shard(text).sort()
    pair = np.flatnonzero(lcp[1:] >= width)
    found = np.zeros(len(text), bool)
    found[order[pair]] = found[order[pair + 1]] = True
    out = []
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        out.append(found[a:max(a, b - width)])
    return out


def _intervals(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


SPANS = "array<struct<a:int,b:int>>"


def shard_repeats(found: DataFrame, width: int) -> DataFrame:
    """(key, h1, h2, windows): intervals of repeated windows of each different run."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        group, held, key = {}, 0, None

        def close() -> pa.RecordBatch:
            names = list(group)
            hits = repeats_in_shard([group[d][0] for d in names], width)
            rows = []
            for d, hit in zip(names, hits, strict=True):
                spans = [(0, len(hit))] if group[d][1] else _intervals(hit)
                rows.append([{"a": a, "b": b} for a, b in spans])
            keep = [k for k, r in enumerate(rows) if r]
            return pa.RecordBatch.from_arrays(
                [pa.array([names[k][i] for k in keep], pa.int64()) for i in range(3)]
                + [pa.array([rows[k] for k in keep], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                ["key", "h1", "h2", "windows"])

        for rb in batches:
            cols = [rb.column(rb.schema.get_field_index(c)).to_pylist() for c in ("key", "h1", "h2", "slice")]
            for k, h1, h2, b in zip(*cols, strict=True):
                if k != key:
                    if held > SHARD:
                        yield close()
                        group, held = {}, 0
                    key = k
                d = (k, h1, h2)
                old = group.get(d)
                if old is None:
                    group[d] = (b, b is None)
                    held += len(b or b"")
                else:                                      # met before, here or in another task
                    if old[0] is None and b is not None:
                        held += len(b)
                    group[d] = (old[0] if old[0] is not None else b, True)
        if group:
            yield close()

    rows = found.where("slice IS NOT NULL OR again").select("key", "h1", "h2", "slice")
    # the bytes first: a mark without bytes only ever follows them
    return rows.repartition("key").sortWithinPartitions(F.col("key"), F.col("h1"), F.col("h2"), F.col("slice").desc_nulls_last()) \
        .mapInArrow(run, f"key long, h1 long, h2 long, windows {SPANS}")


def split_hot(found: DataFrame, width: int) -> DataFrame:
    """Minimizers with more than ``HOT`` different runs: these are cut again
    into runs by the minimizer of ``width`` - 8 bytes, which becomes the key."""
    hot = found.where("slice IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("key")
    hot = stash(hot, "repeats-hot")
    if hot.isEmpty():
        return found                                       # the usual case: nothing more is written
    bytes_of = found.where("slice IS NOT NULL").groupBy("key", "h1", "h2").agg(F.min("slice").alias("bytes")).join(hot, "key")

    def run(batches):
        for rb in batches:
            cols = [rb.column(rb.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "dkey", "start", "bytes")]
            out = []
            for i, d, s, b in zip(*cols, strict=True):
                data = np.frombuffer(b, np.uint8)
                key, first, size, _ = runs(data, np.array([len(b)]), width, width - 8)
                for k, a, n in zip(key.tolist(), first.tolist(), size.tolist(), strict=True):
                    part = b[a:a + n + width - 1]
                    out.append((k, *_digest(part), i, d, s + a, n, part, False))
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["key", "h1", "h2", "doc_id", "dkey", "start", "n", "slice", "again"])

    own = found.join(hot, "key", "left_semi").select("key", "h1", "h2", "doc_id", "dkey", "start").join(bytes_of, ["key", "h1", "h2"])
    finer = own.select("doc_id", "dkey", "start", "bytes").mapInArrow(run, OCCURRENCE)
    return stash(found.join(hot, "key", "left_anti").select(*finer.columns).unionByName(finer), "repeats-split")


def removal_spans(named: DataFrame, width: int) -> DataFrame:
    """(doc_id, dkey, windows): the repeated windows of each text as intervals.

    ``named``: doc_id, text, dkey."""
    keys = stash(repeated_minimizers(named, width), "repeats-keys")
    total = keys.count()
    bits = 1 << min(BITS.bit_length() - 1, max(16, (16 * total).bit_length()))
    parts = max(1, -(-16 * total // BITS))
    out, sc = None, named.sparkSession.sparkContext
    for part in range(parts):
        mine = keys if parts == 1 else keys.where(F.expr(f"pmod(shiftright(key, 40), {parts})") == part)
        marks = sc.broadcast(bitmap(mine, bits))
        found = split_hot(stash(candidates(named, width, part, parts, bits, marks), "repeats-runs"), width)
        r = shard_repeats(found, width).select("key", "h1", "h2", F.explode("windows").alias("w"))
        hits = found.select("key", "h1", "h2", "doc_id", "dkey", "start").join(r, ["key", "h1", "h2"]) \
            .select("doc_id", "dkey", F.struct((F.col("start") + F.col("w.a")).alias("a"), (F.col("start") + F.col("w.b")).alias("b")).alias("w"))
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "dkey").agg(F.collect_set("w").alias("windows"))


def remove_repeats(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, the removed spans (byte ranges,
    merged, in order) and the bytes that are left."""
    named = id_text(docs, id_col, text_col).withColumn("dkey", F.xxhash64("text"))
    spans = removal_spans(named, width).select(F.col("doc_id").alias("s_id"), F.col("dkey").alias("s_key"), "windows")
    joined = named.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("dkey") == F.col("s_key")), "left")

    def run(batches):
        for rb in pieces(batches):
            rows = []
            for t, ws in zip(texts(rb), rb.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for w in sorted(ws or (), key=lambda w: w["a"]):
                    a, b = w["a"], w["b"] - 1 + width      # from the first window's start to the last one's end
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                left, at = [], 0
                for a, b in merged:
                    left.append(t[at:a])
                    at = b
                left.append(t[at:])
                rows.append((len(t), [{"start": a, "stop": b} for a, b in merged], b"".join(left)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(cols[0], pa.int64()),
                 pa.array(cols[1], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(cols[2], pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"])

    return joined.select("doc_id", "text", "windows").mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
