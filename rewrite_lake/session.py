"""SparkSession helpers.

The library never creates a session on its own inside operators; jobs and tests
call :func:`get_session`.  On a cluster the session already exists and carries
``spark.checkpoint.dir``; we only fill in defaults that are unset.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults for a local session (tests, bench).  On a cluster these come from
# spark-defaults / the submitting job and are left alone.
LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    # Text scoring is CPU-heavy per byte: let AQE keep small shuffle outputs
    # spread over the cores instead of coalescing them into one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # The small test tables are one row group each (see spread()).
    "spark.rewriteLake.scanPartitions": "8",
}


def get_session(master: str | None = None, app_name: str = "rewrite_lake",
                extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[8]"))
    for key, value in {**LOCAL_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: ``spark.checkpoint.dir`` of the session.

    Unset, a ``local[...]`` session (tests, bench) gets a scratch folder.  On a
    cluster that is an error: executors would checkpoint to their own disks.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="rewrite-lake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df):
    """``df`` written as Parquet below the shared checkpoint folder, and read back.

    Cuts lineage like a checkpoint, with columns compressed; a lost executor costs
    nothing of it.  Files stay until the folder is cleaned.
    """
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Session setting: partitions to deal a plain scan over (unset: as scanned).
SCAN_PARTITIONS = "spark.rewriteLake.scanPartitions"


def spread(scan, partitions: int | None = None):
    """A plain table scan dealt over ``partitions`` (the session's setting when
    not given, unchanged when neither is).  A file of one row group scans as one
    task, which is too few for CPU-heavy text work on a small table; a large
    table has splits enough and needs no setting."""
    partitions = partitions or scan.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return scan.repartition(int(partitions)) if partitions else scan
