"""Session settings shared by all jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import worktide

# Functions travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(worktide)

# Settings that may be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join side is split even where that costs one more shuffle: a hot
    # key may hold a third of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches of long texts stay small in the JVM and in Python.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

# transformWithState needs the RocksDB store.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


SHUFFLE = "spark.sql.shuffle.partitions"


def configure(spark: SparkSession, streaming: bool = False) -> SparkSession:
    """Apply the settings every job relies on; the sizing of a cluster is left alone."""
    conf = {**RUNTIME_CONF, **(STREAM_CONF if streaming else {})}
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get(SHUFFLE, "200") == "200":
        # One machine: the default is meant for a cluster.
        conf[SHUFFLE] = str(context.defaultParallelism)
    for key, value in conf.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "worktide", memory: str = "16g") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        # A task per core where a small table is one file.
        .config("spark.sql.files.minPartitionNum", cores)
        .config("spark.sql.files.maxPartitionBytes", "32m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the call site of every Column costs more than building plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark, streaming=True)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. On one machine, as in tests, a local one is
    made where that is unset; elsewhere that is an error, since executors would not share it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        path = tempfile.mkdtemp(prefix="worktide-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")
