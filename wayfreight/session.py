"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "wayfreight") -> SparkSession:
    """A session for tests and the bench. On a cluster, bring your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name that every executor can reach, with its file system spelled out.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a single-machine session may
    go without it: a temporary folder stands in there, and anywhere else the job stops, because each
    executor would write to its own disk. A name without a scheme is on Hadoop's default file system,
    as it is for Spark's own readers and writers.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='wayfreight-')}"
    return f"{qualified(spark, base)}/wayfreight/{purpose}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI of the file system that Hadoop takes it to be on."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    on = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return on.makeQualified(hadoop).toString().rstrip("/")


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_dir`` named, once nothing reads it any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
