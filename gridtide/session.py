"""Session settings the plans rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for these plans on a cluster; none of them depends on data size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str | None = None, app: str = "gridtide") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = (
        b.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A local one is made only where none is configured and driver and executors
    are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if path is None:
        path = sc.getCheckpointDir()
    if path is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whichever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory()


def working_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables and stream state, under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
