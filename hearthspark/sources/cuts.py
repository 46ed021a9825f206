"""Lineage cuts and intermediate folders, all in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from spark.checkpoint.dir. Unset, it is a folder of our own on a one-machine master (as in tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = "file://" + tempfile.mkdtemp(prefix="hearth-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, with its scheme."""
    path, store = _path(spark, f"{shared_dir(spark)}/hearth-{what}-{uuid.uuid4().hex}")
    found = store.makeQualified(path).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless it is there already; False if it is. Atomic where the store's create without overwriting is (HDFS); on local disks two writers in the same instant may both pass."""
    found, store = _path(spark, path)
    try:
        out = store.create(found, False)
    except Exception as e:
        if store.exists(found):
            return False
        raise RuntimeError(f"{path} can't be created") from e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    found, store = _path(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(found)) if store.exists(found) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh_dir() named."""
    found, store = _path(spark, path)
    if "/hearth-" not in path:
        raise ValueError(f"{path} is no intermediate folder")
    store.delete(found, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later plans start from files in the shared folder, so lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder. Unlike a checkpoint it has a measured size, columns can be pruned, and it is read again by path."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
