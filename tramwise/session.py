"""Session settings the operators are meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan at run time: split skewed joins, merge small partitions, turn a
    # shuffle join into a broadcast once the real sizes are known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Cut groups down to their top rows before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    # Streaming state beyond the heap; it is checkpointed to the shared folder.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Instants of the transit tables carry no zone.
    "spark.sql.session.timeZone": "UTC",
}


def configure(
    spark: SparkSession, shuffle_partitions: int | None = None
) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session.

    ``shuffle_partitions`` is the number before adaptive merging; on a cluster
    take the shuffled bytes divided by about 200 MB.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if shuffle_partitions is not None:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle_partitions)
    return spark


def checkpoint_root(spark: SparkSession, default: str | None = None) -> str:
    """The shared folder the cluster names for checkpoints.

    ``default`` serves where the session names none, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or default
    if root is None:
        raise ValueError("no checkpoint folder: set spark.checkpoint.dir")
    return root
