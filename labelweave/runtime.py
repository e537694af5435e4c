"""Session settings and staged tables.

Iterative operators cut their lineage with *staged tables*: the frame is written once as
Parquet into the shared folder named by ``spark.checkpoint.dir`` and read back.  A staged table
survives the loss of any executor, is computed exactly once, and has a known file size, so
Catalyst itself decides whether it is small enough to broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit skewed keys; the session owner may apply them.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def work_folder(spark: SparkSession) -> str:
    """The shared folder for staged tables and checkpoints.

    A folder of our own is chosen only when the session names none and runs in a single JVM.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="labelweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _session_folder(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/labelweave-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the work folder."""
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release_staged(spark: SparkSession) -> bool:
    """Delete the staged tables of this application; results that read them must be consumed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str = "stage", rebalance: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    ``rebalance`` evens out the files (AQE splits large and merges small partitions), for tables
    that an iterative learner reads many times.
    """
    if rebalance:
        df = df.hint("rebalance")
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
