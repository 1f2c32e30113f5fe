"""Session helpers: builder for local runs, shared folder, truncated lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vigil-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths that made_path() gave for tables that are still there, oldest first.
_tables: list[str] = []


def made_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there stays until it is dropped."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _tables.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back. It stays until it is dropped, as lazy results read from it."""
    path = made_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def tables() -> tuple[str, ...]:
    return tuple(_tables)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes what lies at paths of made_path(), once no result reads from them any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _tables.remove(path)


def release(spark: SparkSession) -> None:
    """Lets the driver drop shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
