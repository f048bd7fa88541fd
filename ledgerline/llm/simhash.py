"""SimHash near-duplicate groups with pigeonring filtering.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles.  Two fingerprints link when at most ``max_distance`` of their
64 bits differ.  Candidates follow the pigeonring principle: the 64 bits are a
ring of 8 segments; for a linked pair some segment starts a chain whose first
``l`` segments differ in at most ``l * max_distance / 8`` bits, for every
``l``.  For 3 bits the chain's budgets are 0, 0, 1, 1, 1, 2, 2, 3: two equal
segments followed by three that differ in one bit together, so at least two of
those three are equal too.  Each start therefore gives three equi-join keys of
32 exact bits, and the rest of the chain is tested before the full distance.

Equal fingerprints collapse to one node first, so copies never multiply.  A
key that many fingerprints share is cut into blocks; a pair of blocks emits a
spanning forest of its links, never all its pairs.  Components come from
alternating star contraction with every round written to the shared folder.

Defined cases: a document without words has fingerprint 0 and links like any
other; a document without an id links too and its group is named after the
smallest id of the others (NULL if none has one).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, id_text, pieces, stash, texts, unused

SEED = 42
SEGMENTS = 8
FEW = 32          # fingerprints of a key that are joined row by row
BLOCK = 1024      # fingerprints of one block of a key with more


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority of the shingle hashes, bit by bit (0 without words)."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    stop = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(stop[:n - 1] + 1).tolist()]
    stops = stop[-n:].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):                       # bounded memory for very long texts
        part = hashes[at:at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * counts > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches):
        for rb in pieces(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts(rb)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(fp)], ["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _budgets(max_distance: int) -> list[int]:
    """Bits that the first l segments of a chain may differ in, l = 1..8."""
    return [l * max_distance // SEGMENTS for l in range(1, SEGMENTS + 1)]


def _ring(fp: Column, start: int) -> Column:
    """The bits turned so that segment ``start`` comes first (most significant)."""
    k = start * 64 // SEGMENTS
    return fp if not k else F.shiftleft(fp, k).bitwiseOR(F.shiftrightunsigned(fp, 64 - k))


def _keys(max_distance: int) -> list[tuple[int, list[int]]]:
    """(start, segments that are equal) of each equi-join key: the chain's
    leading segments without budget, then all but that many of the segments
    that have a budget of one."""
    budget = _budgets(max_distance)
    if not 0 <= max_distance < SEGMENTS:
        raise ValueError(f"max_distance must be below the {SEGMENTS} segments")
    free = [l for l, b in enumerate(budget) if b == 0]
    ones = [l for l, b in enumerate(budget) if b == 1][:3]
    return [(s, [*free[:4], *([] if len(free) >= 4 else keep)]) for s in range(SEGMENTS)
            for keep in (combinations(ones, len(ones) - 1) if len(free) < 4 else [()])]


def _chain_holds(a: Column, b: Column, start: int, max_distance: int) -> Column:
    """Every prefix of the chain that begins at ``start`` keeps its budget."""
    x = _ring(a.bitwiseXOR(b), start)
    width, ok = 64 // SEGMENTS, F.lit(True)
    for l, most in enumerate(_budgets(max_distance), 1):
        prefix = x if l == SEGMENTS else F.shiftrightunsigned(x, 64 - l * width)
        ok = ok & (F.bit_count(prefix) <= most)
    return ok


def _chain_mask(x: np.ndarray, start: int, max_distance: int) -> np.ndarray:
    """``_chain_holds`` for arrays of xor values."""
    k, width = start * 64 // SEGMENTS, 64 // SEGMENTS
    x = x if not k else (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    ok = np.ones(x.shape, bool)
    for l, most in enumerate(_budgets(max_distance), 1):
        ok &= np.bitwise_count(x >> np.uint64(64 - l * width)) <= most
    return ok


def links(nodes: DataFrame, max_distance: int = 3) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column fp of ``nodes``);
    their connected components are those of all linked pairs."""
    keys = _keys(max_distance)
    per_start, width = len(keys) // SEGMENTS, 64 // SEGMENTS
    ring = [_ring(F.col("fp"), s) for s in range(SEGMENTS)]

    def value(start: int, segments: list[int]) -> Column:
        mask = sum(((1 << width) - 1) << (64 - (l + 1) * width) for l in segments)
        return ring[start].bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))

    entries = nodes.select("fp", F.posexplode(F.array(*[value(s, l) for s, l in keys])).alias("key", "bits"))
    counts = entries.groupBy("key", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = stash(entries.join(counts, ["key", "bits"]), "simhash-keys")
    # keys of a few fingerprints: a plain self-join with the chain and the distance in its condition
    few = entries.where(F.col("n") <= FEW)
    a, b = few.alias("a"), few.alias("b")
    holds = F.lit(False)
    for s in range(SEGMENTS):
        holds = holds | (F.col("a.key").between(s * per_start, (s + 1) * per_start - 1)
                         & _chain_holds(F.col("a.fp"), F.col("b.fp"), s, max_distance))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.bits") == F.col("b.bits"))
                   & (F.col("a.fp") < F.col("b.fp")) & holds).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    # keys of many: blocks of BLOCK fingerprints, each pair of blocks in a task of its own
    many = entries.where(F.col("n") > FEW).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    many = many.select("key", "bits", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    many = many.select("key", "bits", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                       (F.col("own") <= F.col("other")).alias("left"))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf.key.iloc[0]) // per_start
        node = pdf.fp.to_numpy()
        fp = node.view(np.uint64)
        parent = list(range(len(fp)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        left = pdf.left.to_numpy() if (pdf.lo.iloc[0] != pdf.hi.iloc[0]) else None
        out = []
        for i in range(len(fp)):
            if left is not None and not left[i]:
                continue
            x = fp ^ fp[i]
            near = np.flatnonzero((np.bitwise_count(x) <= max_distance) & _chain_mask(x, start, max_distance))
            for j in near.tolist():
                p, q = root(i), root(j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    stars = many.groupBy("key", "bits", "lo", "hi").applyInPandas(forest, "a long, b long")
    return pairs.unionByName(stars).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free checksums of an edge set."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")),
                           F.sum(F.col("a").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable, for every node of an edge.

    Alternating large-star and small-star steps; each step groups by the
    smaller end's neighbours through a join on the minimum, so that no group
    is gathered in one task, and every round is written to the shared folder."""
    edges = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc")
    for _ in range(rounds):
        # large star: each neighbour above a node goes to the node's smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.least("a", "m").alias("a"), "b").where("a < b").distinct()
        # small star: each neighbour below a node, and the node, go to its smallest neighbour
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y").distinct()
        fresh = stash(small.select(F.col("x").alias("a"), F.col("y").alias("b")), "cc")
        was, now = _digest(edges), _digest(fresh)
        edges = fresh
        if was == now:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    raise RuntimeError("components: more rounds are needed")


def _grouped(docs: DataFrame, shingle: int, max_distance: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, root, component) of every row; root tells the groups apart
    where ids repeat and two groups have the same name."""
    fps = stash(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    nodes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(links(nodes, max_distance)).withColumnRenamed("node", "fp")
    grouped = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = grouped.groupBy("root").agg(F.min("least").alias("component"))
    label = grouped.join(names, "root").select("fp", "root", "component")
    return fps.join(label, "fp").select("doc_id", "fp", "root", "component")


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, max_distance: int = 3,
                          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed) and component (the smallest
    doc_id of its group)."""
    return _grouped(docs, shingle, max_distance, id_col, text_col).select("doc_id", "fp", "component")


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with
    the smallest id (one of its rows, if they repeat; of different texts under
    that id, one with the smallest fingerprint).  A group without any id keeps
    all its rows, for nothing names one of them."""
    groups = _grouped(docs, shingle, max_distance, id_col, text_col)
    k, k_fp, own = unused(docs, "keep"), unused(docs, "keep_fp"), unused(docs, "own_fp")
    chosen = groups.where("doc_id = component").groupBy("root").agg(F.min("component").alias(k), F.min("fp").alias(k_fp))
    # ids of several fingerprints: there the id alone doesn't name the document
    several = groups.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("doc_id")
    keep = stash(chosen.join(several, F.col(k) == F.col("doc_id"), "left").select(k, k_fp, F.col("doc_id").isNotNull().alias("several")), "simhash-keep")
    unnamed = groups.where("component IS NULL").select(F.col("fp").alias(k)).distinct()
    kept = docs.join(keep.where("NOT several").select(k), F.col(id_col) == F.col(k), "left_semi")
    kept = _one_row(kept, [id_col], text_col)

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series([np.uint64(fingerprint((t or "").encode(), shingle)).astype(np.int64) for t in text])

    clashing = keep.where("several").select(k, k_fp)
    if not clashing.isEmpty():
        rows = docs.join(clashing.select(k), F.col(id_col) == F.col(k), "left_semi").withColumn(own, fp(F.col(text_col)))
        rows = rows.join(clashing, (F.col(id_col) == F.col(k)) & (F.col(own) == F.col(k_fp)), "left_semi")
        kept = kept.unionByName(_one_row(rows, [id_col, own], text_col).drop(own))
    if unnamed.isEmpty():
        return kept
    rest = docs.where(F.col(id_col).isNull()).withColumn(own, fp(F.col(text_col)))
    return kept.unionByName(rest.join(unnamed, F.col(own) == F.col(k), "left_semi").drop(own))


def _one_row(rows: DataFrame, by: list[str], text_col: str) -> DataFrame:
    """One row for each key, the same one in every run: the least by the hash
    of its text, then of the whole row (rows equal in both are the same)."""
    order = F.struct(F.xxhash64(text_col).alias("t"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("h"))
    picked = rows.groupBy(*by).agg(F.min(F.struct(order.alias("o"), F.struct("*").alias("r"))).alias("p"))
    return picked.select("p.r.*")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicate_groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
