"""Sources (parquet folder, parameterised database) and the CSV sink."""

from ledgerline.sources.bucketed import bucketed_tables, store_bucketed
from ledgerline.sources.csv import export_csv, read_csv
from ledgerline.sources.database import DatabaseSource
from ledgerline.sources.model import SalesTables, from_classic
from ledgerline.sources.parquet import ParquetSource
from ledgerline.sources.tpch import tpch_from_frames, tpch_tables

__all__ = ["bucketed_tables", "store_bucketed", "export_csv", "read_csv", "DatabaseSource", "SalesTables",
           "from_classic", "ParquetSource", "tpch_from_frames", "tpch_tables"]
