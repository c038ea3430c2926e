"""SparkSession construction and the shared checkpoint folder.

On a cluster the session is created by the platform; ``spark.checkpoint.dir``
names a shared folder there and is only read.  Tests and local benches run
without one, so :func:`checkpoint_dir` sets a scratch folder when the setting is
absent and the master is local, and raises on any other master.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this library relies on.  AQE re-plans joins from runtime
# sizes (size-checked broadcast, skew-join splitting, partition coalescing).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when the split costs a shuffle after the join
    # (e.g. a distinct count grouped on top of the join keys).
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Reliable checkpoints (order statistics, model inputs) are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "reelpulse", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[*]"))
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder for reliable checkpoints and written intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session.  When it is unset, a local
    master gets a fresh scratch folder; any other master is an error, as a
    machine-local folder would lose parts or not be found by other machines.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:          # a remote session: the server owns the checkpoint folder
        return configured
    configured = configured or sc.getCheckpointDir()
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir is unset on master {sc.master}: set it to a folder that all "
                           "machines share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="reelpulse-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured
