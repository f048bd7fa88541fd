"""ledgerline -- retail sales analytics as Spark DataFrame plans.

Operators take a ``SalesTables`` (canonical order lines, orders, products,
categories and customers) and return lazy DataFrames.  See README.md.
"""

from ledgerline.params import DEFAULTS, Settings
from ledgerline.session import configure_shuffle, ensure_checkpoint_dir, local_session
from ledgerline.sources.bucketed import bucketed_tables, store_bucketed
from ledgerline.sources.model import SalesTables, from_classic
from ledgerline.sources.tpch import tpch_tables

__all__ = ["DEFAULTS", "Settings", "configure_shuffle", "ensure_checkpoint_dir", "local_session",
           "bucketed_tables", "store_bucketed", "SalesTables", "from_classic", "tpch_tables"]
