"""Table scans. Paths go to Spark's readers untouched, so any store that Spark can open will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def tables(spark: SparkSession, root: str, *names: str) -> list[DataFrame]:
    """Several tables at once."""
    return [table(spark, root, n) for n in names]
