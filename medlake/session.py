"""Session helpers: a tuned SparkSession for local runs and the shared
checkpoint folder used to cut lineage.

On a cluster the session is built by the platform; we only *read* its
settings.  ``spark.checkpoint.dir`` must name a shared (HDFS/S3/ABFS)
folder there.  In local mode (tests, bench) we create a scratch folder
when the setting is unset, never on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app: str = "medlake", shuffle_partitions: int | None = None,
                  driver_memory: str = "16g") -> SparkSession:
    """SparkSession for tests and the bench (``local[cores]``).

    AQE is on so shuffle partition counts coalesce at runtime and skewed
    join partitions are split; the UI is off (no server).
    """
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        # No broadcast from *estimated* sizes: a static plan broadcasts only
        # sides we proved small (row-count checks).  AQE may still turn a
        # join into a broadcast once a shuffle has *measured* the side.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only in
    local mode when the session leaves it unset."""
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not _is_local(spark):
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; on a cluster it must name a shared folder")
    path = tempfile.mkdtemp(prefix="medlake-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts lineage and pins non-deterministic columns (uuid, rand) so a
    re-evaluation after an executor loss cannot change them.  Survives
    executor loss, unlike ``localCheckpoint``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
