"""Session settings and reliable checkpoints."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Join skew is split at run time even where that costs one more exchange. The number of shuffle partitions is the
# cluster's to set, from the size of its data; adaptive execution merges small ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "caseloom") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass `SETTINGS` to spark-submit."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", os.environ.get("CASELOOM_DRIVER_MEMORY", "12g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables, as named by the cluster.

    Only a local session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="caseloom-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder: later steps read one fixed copy and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written_table(df: DataFrame, name: str, schema=None) -> DataFrame:
    """Write `df` under the shared folder and read it back, optionally under another schema."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Partitions for exchanges whose rows are few but costly; adaptive merging goes by bytes only."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers stay, and several share an executor."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that is stored in fewer pieces. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
