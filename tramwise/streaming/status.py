"""Live status per route from an append-only stream of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.service import latest_checks
from ..schema import SERVICE_AVAILABILITY
from ..session import checkpoint_root

#: Columns of the stored status; those of a check, the route first.
STATUS = (
    "route_id BIGINT, availability_id BIGINT, check_time TIMESTAMP_NTZ, "
    "is_operational BOOLEAN, delay_minutes INT, reason STRING, current_capacity INT"
)


def read_checks(
    spark: SparkSession, path: str, files_per_batch: int = 1000
) -> DataFrame:
    """Checks that land as parquet files."""
    return (
        spark.readStream.schema(SERVICE_AVAILABILITY)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def start_live_status(
    checks: DataFrame,
    out: str,
    checkpoint: str | None = None,
    snapshot_every: int = 100,
    **trigger,
) -> StreamingQuery:
    """Write the routes whose newest check changed, one folder per batch.

    The state holds one row per route; checks may arrive in any order. Every
    ``snapshot_every`` batches the status of all routes is written instead of
    the changes, so that readers never go back further than that. A batch that
    is run again after a failure replaces its own folder. The default
    checkpoint lies in the shared folder of the session.

    Batches are numbered by the checkpoint. With a new checkpoint on the same
    ``out`` they start over in a run of their own, whose first snapshot takes in
    what the runs before had.
    """
    spark = checks.sparkSession
    location = checkpoint or f"{checkpoint_root(spark)}/live_status"

    runs = _numbers(spark, out, "run")
    fresh = not _numbers(spark, f"{location}/commits") and not _numbers(spark, f"{location}/offsets")
    run = max(runs, default=-1) + 1 if fresh else max(runs, default=0)

    def write(batch: DataFrame, number: int) -> None:
        kind = "change"
        if number % snapshot_every == 0:
            kind = "snapshot"
            if number > 0 or run > 0:
                earlier = current_status(spark, out, before=(run, number))
                if earlier is not None:
                    batch = latest_checks(earlier.unionByName(batch))
        batch.write.mode("overwrite").parquet(f"{out}/run={run}/kind={kind}/batch_id={number}")

    return (
        latest_checks(checks)
        .writeStream.outputMode("update")
        .option("checkpointLocation", location)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def current_status(
    spark: SparkSession, out: str, before: tuple[int, int] | None = None
) -> DataFrame | None:
    """Newest status per route, from the last snapshot and the changes since.

    Its rows serve as ``service_availability`` for every report on the current
    status. Only the folders since the last snapshot are listed and read.
    ``before`` looks at batches before that (run, number); with none it is ``None``.
    """
    found = []
    for run in sorted(_numbers(spark, out, "run"), reverse=True):
        for kind in ("snapshot", "change"):
            for number in _numbers(spark, f"{out}/run={run}/kind={kind}", "batch_id"):
                if before is None or (run, number) < before:
                    found.append((run, number, kind))
        if any(kind == "snapshot" for _, _, kind in found):
            break
    if not found:
        return None
    last = max((run, number) for run, number, kind in found if kind == "snapshot")
    paths = [
        f"{out}/run={run}/kind={kind}/batch_id={number}"
        for run, number, kind in found
        if (run, number) >= last
    ]
    return latest_checks(spark.read.schema(STATUS).parquet(*paths))


def _numbers(spark: SparkSession, path: str, name: str = "") -> list[int]:
    """Numbers in the names of the entries of a folder, ``name=7`` or ``7``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    entries = [entry.getPath().getName() for entry in files.listStatus(folder)]
    texts = [e.removeprefix(f"{name}=") for e in entries if not name or e.startswith(f"{name}=")]
    return [int(t) for t in texts if t.isdigit()]
