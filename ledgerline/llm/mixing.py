"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are shuffled by hash and cut into blocks.  Ideally
each source that has blocks left is served at every moment in proportion to its
exact weight; when one runs out the weights of the others hold.  Block j of a
source is released in the slot in which that ideal begins to serve it and due
in the one in which it ends; the earliest due released block takes each slot,
so that after any number of slots a source is less than one block away from its
share, over the whole mix.  Weights are taken as exact fractions: nothing is
rounded to a period.  Every document comes exactly once.

Ranks within a source come from a range partitioning on (source, hash) and the
row counts of its partitions, so a source of any size is never in one task.
The slots come from one task that reads a row per source and writes a row per
block; the documents are joined to them.  Every source, however small, has a
schedule of its own.

Defined cases: a NULL source is a source of its own; rows that repeat are
documents of their own, each with its place; columns of any name are kept.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import stash, unused


@dataclass(frozen=True)
class MixParams:
    """``weights``: target weight by source; a source without one gets its
    number of documents to the power ``temper``; one with weight 0 comes after
    the others.  ``period`` and ``max_lanes`` are accepted and have no effect."""

    weights: tuple[tuple[str, float], ...] = ()
    temper: float = 0.5
    block_docs: int = 16
    period: int = 1000
    max_lanes: int = 500
    seed: int = 7


def _served(blocks: list[int], parts: list[int]) -> Iterator[int]:
    """``slot_sources`` for whole positive weights."""
    ends = sorted((Fraction(n, w), n, w) for n, w in zip(blocks, parts, strict=True))     # when each source runs out
    gone, weight = [0], [sum(parts)]                       # blocks of the first k to run out, weight of the others
    for _, n, w in ends:
        gone.append(gone[-1] + n)
        weight.append(weight[-1] - w)
    stops = [e for e, _, _ in ends]
    phase, block = [0] * len(parts), [0] * len(parts)

    def slot(s: int, j: int) -> tuple[int, int]:
        """The slot, rounded down and up, by which j blocks of s are ideally served."""
        k, w = phase[s], parts[s]
        if k < len(ends) and j * ends[k][2] >= ends[k][1] * w:
            k = phase[s] = bisect_right(stops, Fraction(j, w), k)
        return gone[k] + weight[k] * j // w, gone[k] - (-weight[k] * j // w)

    coming = [(0, s) for s in range(len(parts))]
    ready: list[tuple[int, int]] = []
    for t in range(sum(blocks)):
        while coming and coming[0][0] <= t:
            _, s = heappop(coming)
            block[s] += 1
            opens, due = slot(s, block[s])
            heappush(ready, (due, s))
            if block[s] < blocks[s]:
                heappush(coming, (opens, s))
        due, s = heappop(ready)
        if due <= t:
            raise AssertionError("a deadline is missed")
        yield s


def slot_sources(blocks: list[int], weights: list[float]) -> Iterator[int]:
    """The source of each slot of the mix, in memory of the number of sources."""
    if any(not 0 <= w < math.inf for w in weights):
        raise ValueError("weights must be finite and not negative")
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*[w.denominator for w in exact])
    parts = [int(w * scale) for w in exact]
    for group, of in (([s for s, w in enumerate(parts) if w], parts), ([s for s, w in enumerate(parts) if not w], [1] * len(parts))):
        group = [s for s in group if blocks[s]]
        for k in _served([blocks[s] for s in group], [of[s] for s in group]):
            yield group[k]


def schedule(parts: list[int]) -> list[int]:
    """The source of each slot when every source has as many blocks as its weight."""
    return list(slot_sources(parts, parts))


def phases(blocks: list[int], weights: list[float], period: int = 0) -> list[list[tuple[int, int, int, list[int]]]]:
    """For each source with blocks one entry: (first block, first slot, slots
    of the mix, slots of its blocks)."""
    slots: list[list[int]] = [[] for _ in blocks]
    for t, s in enumerate(slot_sources(blocks, weights)):
        slots[s].append(t)
    return [[(0, 0, sum(blocks), x)] if x else [] for x in slots]


def block_slots(counts: DataFrame, params: MixParams) -> DataFrame:
    """(lane, block, slot) of every block; ``counts``: lane, source and n, the
    number of documents, a row per source."""
    given = dict(params.weights)

    def run(batches):
        rows = [r for rb in batches for r in rb.to_pylist()]
        rows.sort(key=lambda r: (-r["n"], r["source"] is not None, r["source"] or ""))
        blocks = [-(-r["n"] // params.block_docs) for r in rows]
        weights = [given.get(r["source"], r["n"] ** params.temper) for r in rows]
        lanes, done, at = pa.array([r["lane"] for r in rows], pa.string()), [0] * len(rows), 0
        slots = slot_sources(blocks, weights)
        while part := list(islice(slots, 1 << 16)):
            block = []
            for s in part:
                block.append(done[s])
                done[s] += 1
            yield pa.RecordBatch.from_arrays([lanes.take(pa.array(part)), pa.array(block, pa.int64()), pa.array(range(at, at + len(part)), pa.int64())],
                                             ["lane", "block", "slot"])
            at += len(part)

    return counts.select("lane", "source", "n").repartition(1).mapInArrow(run, "lane string, block long, slot long")


def positions(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
    """(doc_id, key, source, copy, block, slot, place) of every row: ``key`` is
    the hash that tells apart the texts of one id, ``copy`` numbers rows that
    repeat (0 where there is one), (slot, place) is the order of the mix."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
                        F.col(source_col).cast("string").alias("source"))
    counted = named.groupBy("doc_id", "key", "source").agg(F.count(F.lit(1)).alias("rows"))
    copies = F.when(F.col("rows") > 1, F.sequence(F.lit(1), F.col("rows"))).otherwise(F.array(F.lit(0).cast("long")))
    named = stash(counted.select("doc_id", "key", "source", F.explode(copies).alias("copy")), "mix-rows")
    laned = named.withColumn("lane", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))) \
        .withColumn("h", F.xxhash64(F.lit(params.seed), "doc_id", "key"))
    order = ["lane", "h", "doc_id", "key", "copy"]
    dealt = laned.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches):
        part, lane, n = TaskContext.get().partitionId(), None, 0
        for rb in batches:
            at = []
            for x in rb.column(rb.schema.get_field_index("lane")).to_pylist():
                n = n + 1 if x == lane else 0
                lane = x
                at.append(n)
            keep = [rb.column(rb.schema.get_field_index(c)) for c in ("doc_id", "key", "source", "copy", "lane")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([part] * rb.num_rows, pa.int32()), pa.array(at, pa.int64())],
                                             ["doc_id", "key", "source", "copy", "lane", "part", "at"])

    numbered = stash(dealt.mapInArrow(number, "doc_id long, key long, source string, copy long, lane string, part int, at long"), "mix-numbers")
    # rows of a lane in earlier partitions: a table of at most (partitions + lanes) rows
    parts = numbered.groupBy("lane", "source", "part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("lane", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("lane").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = numbered.join(before, ["lane", "part"]).withColumn("rank", F.col("at") + F.col("before")) \
        .withColumn("block", F.floor(F.col("rank") / params.block_docs))
    slots = stash(block_slots(parts.groupBy("lane", "source").agg(F.sum("n").alias("n")), params), "mix-slots")
    return ranked.join(slots, ["lane", "block"]).select(
        "doc_id", "key", "source", "copy", "block", "slot", (F.col("rank") % params.block_docs).alias("place"))


def mix(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """All documents with their columns, in the order of the mix (partitions
    in order, rows in order within them)."""
    at = stash(positions(docs, params, id_col, text_col, source_col), "mix-places").select(F.struct("*").alias("m"))
    name = unused(docs, "mixed")
    identity = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
                        F.col(source_col).cast("string").alias("source"))
    rows = docs.select(F.struct("*").alias("row"), identity.alias("of"))
    same = F.col("of.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("of.key") == F.col("m.key")) & F.col("of.source").eqNullSafe(F.col("m.source"))
    joined = rows.join(at.where("m.copy = 0"), same)
    # rows that repeat are numbered, in an order that only equal rows share, and take a place each
    repeated = at.where("m.copy = 1")
    again = rows.join(repeated, same, "left_semi").withColumn(
        "copy", F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64("row"))).cast("long"))
    again = again.join(at.where("m.copy > 0"), same & (F.col("copy") == F.col("m.copy")))
    both = joined.select("row", "m").unionByName(again.select("row", "m"))
    out = both.select("row.*", F.struct("m.slot", "m.place").alias(name))
    ordered = out.repartitionByRange(f"{name}.slot", f"{name}.place").sortWithinPartitions(f"{name}.slot", f"{name}.place")
    return ordered.drop(name)


def query(docs: DataFrame) -> DataFrame:
    return positions(docs).select("doc_id", "source", "block", "slot", (F.col("slot") * MixParams().block_docs + F.col("place")).alias("position"))
