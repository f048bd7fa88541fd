"""Connected components of an edge table, for nodes of any orderable type.

Alternating large-star and small-star contraction.  Every step joins a node's
edges with its smallest neighbour (a grouped minimum, combined before the
shuffle), so that a node with a third of all edges is never gathered in one
task; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from ledgerline.llm.common import stash


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, their count and order-free checksums (observed while
    they are written: no second pass)."""
    seen, h = Observation(), F.xxhash64("a", "b")
    kept = stash(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")), "edges")
    return kept, tuple(seen.get[k] for k in "nxs")


def components(edges: DataFrame, rounds: int = 80) -> DataFrame:
    """(node, root) for every end of an edge (a, b); root is the smallest node
    of the component."""
    edges, was = _kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(both.groupBy("a").agg(F.min("b").alias("low")), "a").where("b > a").select(
            F.least("a", "low").alias("a"), "b").distinct()
        small = large.join(large.groupBy("b").agg(F.min("a").alias("low")), "b").select(
            F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        edges, now = _kept(small)
        if now == was:
            roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
        was = now
    raise RuntimeError("components: more rounds are needed")
