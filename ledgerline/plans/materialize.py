"""Cutting lineage.

``materialize`` writes a DataFrame to the session's checkpoint folder
(``spark.checkpoint.dir``, shared storage on a cluster) and returns a frame
that reads it back.  Used where a plan is consumed more than once (a size
check and the query itself) and where row placement must stay fixed across
retries (range-bucket ids): a lost executor then costs a re-read, never a
recomputation that could place rows differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from ledgerline.session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpoint ``df`` and return it with its row count.

    The count is an observed metric of the checkpoint job itself, so no
    second pass over the data is needed.  It only steers a plan choice
    (single task or buckets, bucket count), never a result, so a stage
    re-run after executor loss that counted twice could not change output.
    """
    ensure_checkpoint_dir(df.sparkSession)
    obs = Observation()
    pinned = df.observe(obs, F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    return pinned, int(obs.get["rows"])
