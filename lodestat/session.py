"""Session helpers.

The library never creates its own cluster settings on top of a session it is
handed; ``ensure_checkpoint_dir`` only fills ``spark.checkpoint.dir`` when the
cluster left it unset (local tests), and then only with a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a job in this library expects; a cluster may override any of them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lodestat") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LODESTAT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is; without
    it there is an error, as executors do not see each other's folders.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="lodestat-ckpt-", dir=os.environ.get("LODESTAT_SCRATCH", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


def materialize(df, key: list[str] | None = None):
    """Write a frame that several jobs of one query reuse to the session's
    checkpoint folder (shared storage on a cluster) and cut its lineage: later
    jobs read the files instead of recomputing the upstream, and a lost
    executor costs a re-read, not a recomputation.

    With ``key`` the frame is hash-partitioned on it as it is written
    (``spark.sql.shuffle.partitions`` parts, which AQE may coalesce when they
    are small), so the heavy jobs that follow get evenly sized tasks whatever
    the upstream layout."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if key:
        df = df.repartition(*key)
    return df.checkpoint(eager=True)
