"""Token-ID output in Simple-8b word-aligned blocks.

The library encodes each whole text (pre-tokens that a worker has met before
are looked up), the end id is appended, and the ids of consecutive
documents are packed: every 64-bit word holds a 4-bit selector and as many ids
of the selector's width as fit in 60 bits.  An id too wide for any selector is
an escape: the selector alone, then the id as a whole word.  Blocks of
``BLOCK`` ids begin at recorded word offsets, so that all blocks of a segment
are packed and decoded together with array operations.

A file is a Parquet table written by Spark (its committer survives lost tasks):
one row per segment of whole documents, in document order:
(shard, segment, n_ids, doc_ids, sizes, offsets, words).

Defined cases: a NULL or empty text has the end id alone; rows that repeat are
written as often as they come; NULL ids come first; special strings inside a
text become their special id, as the library's default has it.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import id_text, pieces
from ledgerline.llm.tokens import BYTE_PATTERN, PLAIN, Recent, byte_alphabet, definition, public_path, special_splitter, tokenizer
from ledgerline.session import ensure_checkpoint_dir

# Fixed values of the coding: ids of a word for selectors 0, 1, 2, ...
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 4096
SEGMENT = 1 << 18        # a segment closes after the document that reaches so many ids
# Simple texts: no white space but single blanks and line ends, and beyond ASCII only letters.
SIMPLE = regex.compile("[\n -~À-ÖØ-öø-įı-ňŊ-ǃǍ-ǯ]*").fullmatch
ODD_SPACE = ("  ", " \n", "\n ", "\n\n")
CONTRACTION = regex.compile("'(?:[stmd]|re|ve|ll)").search
KIND = np.array([0 if c == 0x0A else 4 if c == 0x20 else 1 if c >= 0x80 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)
KEPT = 400_000           # pre-tokens whose ids a worker remembers (two generations of about 75 MB)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id (at least 1)."""
    high = np.frexp((ids >> np.uint64(32)).astype(np.float64))[1].astype(np.uint8)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)
    return np.maximum(np.where(high, high + 32, low), 1).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block) of unsigned ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # blocks as rows; beyond the last id a row is padded with zeros, which any selector takes
    pad = max(COUNTS)
    table = np.zeros((blocks, BLOCK + pad), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    table[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    table = table.ravel()
    width = _widths(table)
    selector = np.full(len(table), ESCAPE, np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):             # the fullest word that fits wins
        fits, have, count = width <= 60 // COUNTS[s], 1, COUNTS[s]
        while have < count:                              # all of the next ``count`` ids, by doubling
            step = min(have, count - have)
            fits = fits[:len(fits) - step] & fits[step:]
            have += step
        selector[:len(fits)][fits] = s
    taken = np.array([*COUNTS, 0, 1], np.int64)[selector]
    size = np.full(blocks, BLOCK, np.int64)
    size[-1] = n - (blocks - 1) * BLOCK
    # all blocks advance by one word at a time
    row, at, begins, rows = np.arange(blocks) * (BLOCK + pad), np.zeros(blocks, np.int64), [], []
    live = np.arange(blocks)
    while len(live):
        here = row[live] + at[live]
        begins.append(here)
        rows.append(live)
        at[live] += taken[here]
        live = live[at[live] < size[live]]
    begin, owner = np.concatenate(begins), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    begin, owner = begin[order], owner[order]
    sel = selector[begin].astype(np.int64)
    long = sel == ESCAPE
    place = np.cumsum(1 + long) - (1 + long)             # an escape takes two words
    words = np.zeros(len(begin) + int(long.sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    words[place[long] + 1] = table[begin[long]]
    for s, count in enumerate(COUNTS):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            bits, value = 60 // count, words[place[mine]]
            for k in range(count):
                value |= table[begin[mine] + k] << np.uint64(bits * k)
            words[place[mine]] = value
    return words, place[np.searchsorted(owner, np.arange(blocks))]


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids; every block is decoded from its own offset."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is raw; escapes are rare, so they are settled in order
    raw = np.zeros(len(words) + 1, bool)
    for k in np.flatnonzero(sel == ESCAPE).tolist():
        if not raw[k]:
            raw[k + 1] = True
    raw = raw[:-1]
    head = np.flatnonzero(~raw)
    sel = sel[head]
    held = np.array([*COUNTS, 0, 1], np.int64)[sel]
    block = np.searchsorted(offsets, head, "right") - 1
    before = np.cumsum(held) - held
    first = before[np.searchsorted(head, offsets)]       # ids written before each block's first word
    target = block * BLOCK + before - first[block]
    out = np.zeros(len(offsets) * BLOCK + max(COUNTS), np.uint64)
    # later blocks overwrite an earlier block's padding, so widths go block by block parity
    end = np.minimum((block + 1) * BLOCK, n)
    for s, count in enumerate(COUNTS):
        mine = np.flatnonzero(sel == s)
        bits = 60 // count
        mask = np.uint64((1 << bits) - 1)
        for k in range(count if len(mine) else 0):
            t = target[mine] + k
            ok = t < end[mine]
            out[t[ok]] = (words[head[mine[ok]]] >> np.uint64(bits * k)) & mask
    esc = np.flatnonzero(sel == ESCAPE)
    out[target[esc]] = words[head[esc] + 1]
    return out[:n]


def _simple(text: str) -> bool:
    """Whether a text's pre-tokens begin just where the kind of character changes."""
    return SIMPLE(text) is not None and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ODD_SPACE) \
        and not ("'" in text and CONTRACTION(text))


def _pretokens(texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of simple texts: the number of every pre-token among the distinct ones,
    these, and the first place of each text (and the end).  A blank belongs to
    what follows it; a line end stands alone."""
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    if not len(joined):
        return np.zeros(0, np.int64), [], np.zeros(1, np.int64)
    kind = KIND[joined]
    start = np.append(0, np.flatnonzero((kind[1:] != kind[:-1]) & (joined[:-1] != 0x20)) + 1)
    offsets = np.append(start, len(joined))
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
    between = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])[:-1] - 1)      # the line ends between texts belong to none
    which = np.delete(found.indices.to_numpy(), between)
    return which, found.dictionary.cast(pa.large_string()).to_pylist(), np.concatenate([[0], between - np.arange(len(between)), [len(which)]])


class Encoder:
    """The ids of texts as the tokenizers library gives them, by pre-token."""

    def __init__(self, path: str):
        self.path, self.tokenizer, d = path, tokenizer(path), definition(path)
        self.special, self.special_ids = special_splitter(path)
        pre = d["pre_tokenizer"]
        self.known_kind = d["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        self.pattern = regex.compile(BYTE_PATTERN)
        from tokenizers.models import BPE

        m, alphabet = d["model"], byte_alphabet()
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        # a byte that no merge knows stands between pre-tokens, so that one call takes many
        used = {c for pair in merges for x in pair for c in x}
        self.between = next((b for b in range(0x20) if alphabet[b] not in used and alphabet[b] in m["vocab"]), None)
        self.known_kind &= self.between is not None
        if self.known_kind:
            self.between_id, self.between_char = m["vocab"][alphabet[self.between]], chr(self.between)
            self.table = str.maketrans({chr(b): c for b, c in enumerate(alphabet)})
            self.model = BPE(vocab=m["vocab"], merges=merges, cache_capacity=0)
        self.words = Recent(KEPT)

    def _parts(self, pretokens: list[str]) -> list[bytes]:
        """Ids of single pre-tokens; one call of the model takes many."""
        out: list[bytes] = []
        for at in range(0, len(pretokens), 1000):
            text = self.between_char.join(pretokens[at:at + 1000]).encode().decode("latin-1").translate(self.table)
            ids = np.array([t.id for t in self.model.tokenize(text)], "<u4")
            cut = np.flatnonzero(ids == self.between_id)
            raw, starts, stops = ids.tobytes(), [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), 4 * len(ids)]
            out += [raw[p:q] for p, q in zip(starts, stops, strict=True)]
        return out

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _mixed(self, text: str) -> list:
        """Parts of a text in order: their ids, or their pre-tokens as a list."""
        if not self.known_kind:
            return [self._library(text)]
        parts = self.special.split(text) if self.special is not None else [text]
        marks = [np.array([self.special_ids[m]], "<u4").tobytes() for m in self.special.findall(text)] if len(parts) > 1 else []
        out: list = []
        for k, p in enumerate(parts):
            if p:
                out.append(self.pattern.findall(p) if PLAIN(p) else self._library(p))
            if k < len(marks):
                out.append(marks[k])
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plain, mixed = [], {}
        for k, t in enumerate(texts):
            if t and self.known_kind and _simple(t) and not (self.special is not None and self.special.search(t)):
                plain.append(k)
            else:
                mixed[k] = self._mixed(t)
        which, distinct, bounds = _pretokens([texts[k].encode() for k in plain])
        words = self.words
        fresh = words.fresh({*distinct, *chain.from_iterable(x for parts in mixed.values() for x in parts if isinstance(x, list))})
        words.update(zip(fresh, self._parts(fresh), strict=True))
        get, out = words.__getitem__, [b""] * len(texts)
        for k, parts in mixed.items():
            out[k] = b"".join(b"".join(map(get, x)) if isinstance(x, list) else x for x in parts)
        each = list(map(get, distinct))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first, held = np.cumsum(size) - size, size[which]
        ends = np.append(0, np.cumsum(held))
        ids = np.frombuffer(b"".join(each), "<u4")[np.repeat(first[which] - ends[:-1], held) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[bounds]).tolist()
        for k, p, q in zip(plain, cuts, cuts[1:], strict=False):
            out[k] = ids[p:q]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


FILE = "shard long, segment long, n_ids long, doc_ids array<long>, sizes array<long>, offsets array<long>, words binary"


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2, order: list[Column] | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents to ``out`` in ascending id order (or by
    the columns in ``order``)."""
    path = path or public_path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()
    keys = order or [F.col(id_col).cast("long")]
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                        *[k.alias(f"_order{i}") for i, k in enumerate(keys)])
    by = [F.col(f"_order{i}").asc_nulls_first() for i in range(len(keys))] + [F.col("doc_id"), F.xxhash64("text")]
    # the whole order deals the rows, so many with one id, or with none, are spread too
    dealt = named.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc, shard, segment = encoder(path), TaskContext.get().partitionId(), 0
        ids, sizes, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            words, offsets = pack(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([segment]), pa.array([held]), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                 pa.array([words.astype("<u8").tobytes()], pa.binary())],
                ["shard", "segment", "n_ids", "doc_ids", "sizes", "offsets", "words"])

        for rb in pieces(batches):
            for i, part in zip(rb.column(0).to_pylist(), enc.encode_batch(rb.column(1).to_pylist()), strict=True):
                part += end
                ids.append(i)
                sizes.append(len(part) // 4)
                parts.append(part)
                held += len(part) // 4
                if held >= SEGMENT:
                    yield close()
                    ids, sizes, parts, held, segment = [], [], [], 0, segment + 1
        if ids:
            yield close()

    dealt.mapInArrow(run, FILE).write.option("compression", "zstd").parquet(out)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a written folder: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 and, on demand, the ids."""
    rows = spark.read.schema(FILE).parquet(path)
    # starts: a running sum over the shards' totals (one row per shard), then within each shard
    totals = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("shard", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("s")) \
        .join(shards, "shard").select("shard", "segment", (F.col("s") + F.col("shard_start")).alias("start"))

    def run(batches):
        for rb in batches:
            for k in range(rb.num_rows):
                shard, segment, n, doc_ids, sizes, offsets, words = (c[k].as_py() for c in rb.columns)
                ids = unpack(np.frombuffer(words, "<u8"), np.array(offsets, np.int64), n).astype("<u4")
                stop = np.cumsum(np.array(sizes, np.int64))
                start = stop - np.array(sizes, np.int64)
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                cols = [pa.array([shard] * len(sizes), pa.int64()), pa.array([segment] * len(sizes), pa.int64()),
                        pa.array(doc_ids, pa.int64()), pa.array(start), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                names = ["shard", "segment", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[a:b].tolist() for a, b in zip(start, stop, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "shard long, segment long, doc_id long, within long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    found = rows.mapInArrow(run, schema).join(starts, ["shard", "segment"])
    return found.select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32",
                        *(["ids"] if with_ids else []))


def query(docs: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Write all documents to the shared folder and read the digest back."""
    spark = docs.sparkSession
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, out, order=order)
    return read_tokens(spark, out)
