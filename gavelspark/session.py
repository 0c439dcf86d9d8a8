"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session with the settings the engine expects (tests and bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gavelspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GAVEL_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local master, as in tests, gets a temporary folder.

    A machine-local folder would be lost with its executor, so on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if folder := sc.getCheckpointDir():
        return folder
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gavelspark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


def _storable(df: DataFrame) -> bool:
    """Whether a Parquet file can hold the table: no name twice, no column without a type."""
    names = [c.lower() for c in df.columns]
    return len(names) == len(set(names)) and bool(names) and not any("void" in kind or "interval" in kind for _, kind in df.dtypes)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in shared storage; an executor lost later costs no recomputation.

    The table is written once and read back, with its size known to the optimizer; ``checkpoint`` computes it twice and
    serves only tables that Parquet cannot hold. What is written is deleted when the driver ends.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not _storable(df):
        return df.checkpoint(eager=True)
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
