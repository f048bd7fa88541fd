"""MinHash near-duplicates with sequential Bayesian verification.

A document is its set of distinct word shingles, held as 64-bit hashes.  Equal
sets collapse to one node.  A node has ``BANDS`` x ``ROWS`` minima for the band
keys and a signature of ``BATCHES`` x ``BATCH`` minima, a byte each, for the
verification; pairs that share a band key are candidates.

A candidate's signatures are compared batch by batch.  With a uniform prior,
after n compared and m equal minima the similarity is at least t with
posterior probability P(Bin(n + 1, t) <= m); the pair is given up as soon as
that falls below the chosen miss probability, spread over the batches.  Bytes
that agree by chance only raise m, so they never cost a link.  Survivors are
confirmed on the full sets, made again from both texts.

Buckets may hold a third of all rows, so pairs are not listed bucket by
bucket.  First every node meets its buckets' pivots (a linear number of
pairs) and its most similar pivot is confirmed; the links found are
contracted, and the rounds repeat with other pivots.  What is left is pairs
between different groups inside one bucket: small buckets are joined row by
row; in large ones the nodes outside the bucket's largest group meet its
nodes block by block, in tasks that return links only.  Every such pair is
examined, once; none is capped or sampled.

Defined cases: a text without words (or NULL) has no set and is linked with
nothing; its component is its own id.  A row without an id links like any
other; a group is named after its smallest id, or NULL if none has one.  Rows
that repeat are documents of their own.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, id_text, pieces, stash, texts
from ledgerline.llm.graph import components

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 24, 4       # a pair at 0.8 misses every band with probability 3e-6
BATCH, BATCHES = 16, 8    # minima of a signature
MISS = 1e-6               # posterior probability at which a candidate is given up, over all batches
FEW = 32                  # nodes of a bucket that are joined row by row
BLOCK = 2048              # nodes of one block of a larger bucket
STARS = 2                 # rounds of pivots before the pairs that are left
WORDS_KEPT = 200_000      # hashes of words that a task remembers

_RNG = np.random.default_rng(12)
MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS + BATCH * BATCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS + BATCH * BATCHES, dtype=np.uint64)
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Hash of every word seen, forgotten all at once when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, 4)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX_A
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, words: _Words, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    found = text.translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(shingle, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = _mixed(h * MIX_B + w[j:j + n])
    return np.unique(h)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a set (32 bits each)."""
    low = np.full(len(MULTIPLY), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[at:at + 1024, None] * MULTIPLY + ADD).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def least_equal(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """Equal minima needed after each batch to go on."""
    t, out = percent / 100, []
    for n in range(BATCH, BATCH * BATCHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss / BATCHES:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t)**(n + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature matrices that no batch gives up, and their equal minima."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (a[alive, part] == b[alive, part]).sum(1)
        keep = equal >= need
        alive, equal = alive[keep], equal[keep]
    return alive, equal


def signatures(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, node, sig, keys, packed) of every row: the size of its set,
    the set's 128-bit digest (NULL if empty), its signature, its band keys and
    its text, compressed, for the exact check."""

    def run(batches):
        words, pack = _Words(), zstandard.ZstdCompressor(3)
        for rb in pieces(batches):
            n, node, sig, keys, packed = [], [], [], [], []
            for t in texts(rb):
                s = shingle_set(t, words, shingle)
                n.append(len(s))
                if not len(s):
                    for out in (node, sig, keys, packed):
                        out.append(None)
                    continue
                low = minima(s)
                band = np.full(BANDS, 1, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for row in low[:BANDS * ROWS].reshape(BANDS, ROWS).T:
                    band = _mixed(band * MIX_B + row)
                node.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append((low[BANDS * ROWS:] & np.uint32(255)).astype(np.uint8).tobytes())
                keys.append(band.view(np.int64))
                packed.append(pack.compress(t))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                ["doc_id", "n", "node", "sig", "keys", "packed"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n long, node binary, sig binary, keys array<long>, packed binary")


def _matrix(column) -> np.ndarray:
    """Signatures of an Arrow or pandas column as a matrix of bytes."""
    return np.frombuffer(b"".join(getattr(column, "to_pylist", column.tolist)()), np.uint8).reshape(-1, BATCH * BATCHES)


def bayes(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that sequential verification keeps, with equal minima."""
    least = least_equal(percent, miss)

    def run(batches):
        for rb in batches:
            if rb.num_rows:
                alive, equal = survivors(_matrix(rb.column("sa")), _matrix(rb.column("sb")), least)
                yield pa.RecordBatch.from_arrays([*(rb.column(c).take(pa.array(alive)) for c in "ab"), pa.array(equal)], ["a", "b", "equal"])

    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, equal long")


def confirmed(pairs: DataFrame, bodies: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        words, unpack = _Words(), zstandard.ZstdDecompressor()
        for big in batches:
            for rb in pieces([big], "ta", 1 << 20):
                held: dict[bytes, np.ndarray] = {}
                links = []
                for a, b, ta, tb in zip(*(rb.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                    for node, packed in ((a, ta), (b, tb)):
                        if node not in held:
                            held[node] = shingle_set(unpack.decompress(packed), words, shingle)
                    x, y = held[a], held[b]
                    shared = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                    links.append(100 * shared >= percent * (len(x) + len(y) - shared))
                keep = pa.array(links, pa.bool_())
                yield pa.RecordBatch.from_arrays([rb.column(c).filter(keep) for c in "ab"], ["a", "b"])

    both = pairs.select("a", "b").join(bodies.select(F.col("node").alias("a"), F.col("packed").alias("ta")), "a").join(
        bodies.select(F.col("node").alias("b"), F.col("packed").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _sizes_fit(x: str, y: str, percent: int):
    """A link needs sets whose sizes differ by less than the threshold."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _large(live: DataFrame, nodes: DataFrame, bodies: DataFrame, shingle: int, percent: int, miss: float) -> DataFrame:
    """Links between different groups in buckets of many nodes.

    In a bucket only nodes outside its largest group can lack a link, so a
    task compares a block of those with a block of the bucket's nodes.  It
    holds their signatures and texts, examines a pair in the first band that
    the pair shares only, most similar first, and returns links that connect
    groups not connected before (a forest), never all pairs."""
    least = least_equal(percent, miss)
    sizes = live.groupBy("key", "root").agg(F.count(F.lit(1)).alias("in_group"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("in_group", "root")).alias("main"),
                                    (F.sum("in_group") - F.max("in_group")).alias("outside"))
    rows = live.join(main, "key").withColumns({
        "out": F.col("root") != F.col("main"), "mblocks": F.ceil(F.col("held") / F.lit(BLOCK)).cast("int"),
        "oblocks": F.ceil(F.col("outside") / F.lit(BLOCK)).cast("int")})
    h = F.xxhash64("node")
    every = rows.select("key", "node", "root", "out", F.lit(False).alias("asks"), F.pmod(h, F.col("mblocks")).cast("int").alias("m"),
                        F.explode(F.sequence(F.lit(0), F.col("oblocks") - 1)).alias("o"))
    asks = rows.where("out").select("key", "node", "root", "out", F.lit(True).alias("asks"),
                                    F.explode(F.sequence(F.lit(0), F.col("mblocks") - 1)).alias("m"),
                                    F.pmod(h, F.col("oblocks")).cast("int").alias("o"))
    cut = every.unionByName(asks.select(every.columns)).join(nodes.select("node", "n", "sig", "keys"), "node").join(bodies, "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, words, unpack, sets = pdf.key.iloc[0], _Words(), zstandard.ZstdDecompressor(), {}
        asked, every = (pdf[pdf.asks == x].reset_index(drop=True) for x in (True, False))

        def full(node, packed):
            if node not in sets:
                sets[node] = shingle_set(unpack.decompress(packed), words, shingle)
            return sets[node]

        label = pd.concat([asked.root, every.root]).factorize()[0]
        sig, keys, n = _matrix(every.sig), np.array(every["keys"].tolist()).reshape(-1, BANDS), every.n.to_numpy()
        out = []
        for i, row in enumerate(asked.itertuples(index=False)):
            near = np.flatnonzero((np.minimum(n, row.n) * 100 >= np.maximum(n, row.n) * percent) & (label[len(asked):] != label[i])
                                  & (~every.out.to_numpy() | (every.node.to_numpy() > row.node)))
            mine = np.array(row.keys)
            near = near[mine[(keys[near] == mine).argmax(1)] == key]
            kept, equal = survivors(np.broadcast_to(np.frombuffer(row.sig, np.uint8), (len(near), sig.shape[1])), sig[near], least)
            for j in near[kept[np.argsort(-equal, kind="stable")]].tolist():
                if label[len(asked) + j] == label[i]:
                    continue
                x, y = full(row.node, row.packed), full(every.node[j], every.packed[j])
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    out.append((row.node, every.node[j]))
                    label[label == label[i]] = label[len(asked) + j]
        return pd.DataFrame(out, columns=["a", "b"])

    return cut.groupBy("key", "m", "o").applyInPandas(run, "a binary, b binary")


def _roots(nodes: DataFrame, bodies_of, shingle: int, percent: int, miss: float) -> DataFrame:
    """(node, root) of every node that has a link."""
    every = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("key")
    rows = stash(every.join(shared, "key").withColumn("root", F.col("node")), "minhash-buckets", "lz4")
    sigs = nodes.select("node", "sig")
    bodies = stash(bodies_of(rows.select("node").distinct()), "minhash-texts")
    links = roots = None

    def contract(fresh: DataFrame) -> bool:
        """Adds links; True if there were any."""
        nonlocal links, roots
        fresh = stash(fresh, "minhash-links")
        if fresh.isEmpty():
            return False
        links = fresh if links is None else links.unionByName(fresh)
        roots = components(links)
        return True

    for k in range(STARS):
        order = F.xxhash64("node", F.lit(k))
        pivots = rows.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "n", "root")).alias("p"),
                                         F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "p")
        pairs = rows.join(pivots, "key").where((F.col("root") != F.col("p.root")) & _sizes_fit("n", "p.n", percent)).select(
            F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        likely = stash(bayes(pairs, sigs, percent, miss), "minhash-likely")
        # of a node's pivots the most similar one, for each end of a pair
        ends = likely.select(F.explode(F.array("a", "b")).alias("x"), "a", "b", "equal")
        best = ends.groupBy("x").agg(F.max(F.struct("equal", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
        if not contract(confirmed(best, bodies, shingle, percent)):
            break
        rows = stash(rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-buckets", "lz4")
    # the pairs that are left, between different groups of a bucket
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("root").alias("low"), F.max("root").alias("high"))
    live = stash(rows.join(several.where("low < high").select("key", "held"), "key"), "minhash-open", "lz4")
    x, y = live.where(F.col("held") <= FEW).alias("x"), live.where(F.col("held") <= FEW).alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
                   & _sizes_fit("x.n", "y.n", percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    left = confirmed(bayes(pairs, sigs, percent, miss), bodies, shingle, percent)
    contract(left.unionByName(_large(live.where(F.col("held") > FEW), nodes, bodies, shingle, percent, miss)))
    return roots if roots is not None else nodes.select("node", F.col("node").alias("root")).limit(0)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    table = stash(signatures(docs, shingle, id_col, text_col), "minhash-sigs")
    full = table.where("node IS NOT NULL")
    nodes = stash(full.select("node", "n", "sig", "keys").dropDuplicates(["node"]), "minhash-nodes")

    def bodies_of(wanted: DataFrame) -> DataFrame:
        return full.groupBy("node").agg(F.min("packed").alias("packed")).join(wanted, "node", "left_semi")

    roots = _roots(nodes, bodies_of, shingle, percent, miss)
    ids = full.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
    ids = stash(ids.select("node", "least", F.coalesce("root", "node").alias("root")), "minhash-roots")
    names = ids.select("node", "root").join(ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = table.select("doc_id", "n", "node").join(names, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
