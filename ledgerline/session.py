"""Session helpers.

The library never creates a session behind the caller's back; operators take
DataFrames.  ``local_session`` is for tests, scripts and the benchmark, and
``ensure_checkpoint_dir`` makes sure ``DataFrame.checkpoint`` has a reliable
folder to write to before an operator cuts lineage.
"""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import SparkSession

# Settings every analysis relies on: UTC so dates never shift, ANSI so bad
# arithmetic fails loudly, AQE so joins and partition counts are re-planned
# from runtime statistics (including skew-join splitting).
# Runtime SQL settings for skew: AQE splits a join partition that is far
# larger than the median (a hot order holding a large share of all lines).
# ``forceOptimizeSkewedJoin`` lets it do so even where the split costs an
# extra shuffle because the next aggregation reused the join's partitioning
# (the product-month base does); the extra shuffle only appears when skew is
# actually measured.
SKEW_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

CORE_CONF = {
    # Checkpoints pin intermediate results; let Spark delete them once the
    # checkpointed data is no longer referenced, so repeated runs do not
    # leak files into the shared checkpoint folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    **SKEW_CONF,
}


def apply_skew_conf(spark: SparkSession) -> None:
    """Set the skew-handling SQL settings on an existing session."""
    for key, value in SKEW_CONF.items():
        spark.conf.set(key, value)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "ledgerline", **extra: str) -> SparkSession:
    """A local session configured like the tests and benchmark expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    if "spark.sql.warehouse.dir" not in extra:   # keep catalog files out of the working folder
        builder = builder.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="ledgerline-warehouse-"))
    for key, value in {**CORE_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the checkpoint folder, configuring it from the session if needed.

    On a cluster the folder must be shared storage named by
    ``spark.checkpoint.dir``; a machine-local temporary folder is only used
    when the master is local and nothing is configured (tests).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: the server owns checkpointing
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-ckpt-"))
    else:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage "
            "(HDFS/S3/ABFS) so checkpointed stages survive executor loss")
    return sc.getCheckpointDir()


def shuffle_partitions_for(input_bytes: int, target_bytes: int = 128 * 1024 * 1024,
                           minimum: int = 1, maximum: int = 200_000) -> int:
    """Partitions so that a shuffle of about ``input_bytes`` gives pieces of
    about ``target_bytes``."""
    return max(minimum, min(maximum, math.ceil(max(input_bytes, 0) / max(target_bytes, 1))))


def configure_shuffle(spark: SparkSession, tables, target_bytes: int = 128 * 1024 * 1024) -> int:
    """Size the shuffles from the line table, the largest input.

    AQE merges small shuffle partitions but never splits large ones (apart
    from skewed joins), so the initial count must be large enough for the
    biggest shuffle: about one partition per ``target_bytes`` of line data,
    at least the cluster's parallelism.  Uses the scan's size estimate (file
    sizes), so no job runs.  Returns the partition count that was set.
    """
    from ledgerline.plans.joins import estimated_bytes

    est = estimated_bytes(tables.order_details) or 0
    try:
        parallelism = spark.sparkContext.defaultParallelism
    except Exception:  # remote session: no SparkContext on the client
        parallelism = int(spark.conf.get("spark.default.parallelism", "200"))
    n = shuffle_partitions_for(est, target_bytes, minimum=parallelism)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    return n
