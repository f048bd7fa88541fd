"""Plan-level building blocks: checked broadcast joins, lineage cuts and
ordered windows that never hold an unbounded group in one task."""

from ledgerline.plans.joins import broadcast_fits, join_dimension
from ledgerline.plans.materialize import materialize
from ledgerline.plans.ordered import WindowOutputs, ntile_from_index, ordered_window

__all__ = ["broadcast_fits", "join_dimension", "materialize", "WindowOutputs",
           "ntile_from_index", "ordered_window"]
