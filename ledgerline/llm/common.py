"""Small helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* a NULL text counts as the empty text; a NULL id is kept and returned;
* every input row is a document of its own, also when ids or rows repeat;
* only the named id and text columns are read, so extra columns (whatever
  their names) neither matter nor leak into the result;
* an empty table gives an empty result with the usual columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import ensure_checkpoint_dir

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

# Lower-cases A-Z and turns every byte that is not part of a word
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ into a blank.
WORD_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
                   for c in range(256))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row, NULL text as ''."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def stash(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet to the shared checkpoint folder and read it
    back: lineage is cut, the data survives lost executors, and later reads
    prune columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a table (file sizes; runs no job)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(batches: Iterable[pa.RecordBatch], text_col: str = "text", max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``max_bytes`` of text
    (one document at least), whatever the batch size of the session."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        col = rb.column(rb.schema.get_field_index(text_col))
        size = np.cumsum(lengths(col))
        at = 0
        while at < rb.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + max_bytes, "right")))
            yield rb.slice(at, end - at)
            at = end


def lengths(col: pa.Array) -> np.ndarray:
    """Bytes of each string of an Arrow column (NULL: 0)."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(rb: pa.RecordBatch, text_col: str = "text") -> list[bytes]:
    col = rb.column(rb.schema.get_field_index(text_col))
    return col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
