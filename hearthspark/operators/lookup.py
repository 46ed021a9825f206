"""Indexes over large tables: trigrams for substring searches, a directory for deep pages. Both are tables in a folder that the caller names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthspark.functions import expr as E

GRAM = 3
#: Folders of postings; a search opens those of its pattern's grams.
FOLDERS = 64


def _folder(gram: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")


def grams(text: Column) -> Column:
    """Distinct runs of GRAM characters, in lower case as ilike() has it."""
    t = F.lower(text)
    at = F.sequence(F.lit(1), F.greatest(F.length(t) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substr(t, i, F.lit(GRAM))))


def build_trigrams(rows: DataFrame, key: str, columns: list[str], root: str, folders: int = FOLDERS) -> None:
    """Postings (gram, key) of the columns' texts, by folder and sorted by gram, so that a scan for a few grams skips the rest. A gram that a third of all rows hold is just many rows."""
    one = [F.coalesce(grams(F.col(c)), F.array().cast("array<string>")) for c in columns]
    posted = rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.concat(*one))).alias("gram")).filter(F.length("gram") == GRAM).withColumn("folder", _folder(F.col("gram"), folders))
    posted.repartitionByRange("folder", "gram", "key").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(root)


def postings(spark: SparkSession, root: str, wanted: list[str], folders: int = FOLDERS) -> DataFrame:
    """The postings of some grams: only their folders are listed and read."""
    places = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(_folder(F.col("g"), folders)).distinct().collect()]
    return spark.read.parquet(root).filter(F.col("folder").isin(places) & F.col("gram").isin(wanted))


def pattern_grams(spark: SparkSession, pattern: str, escape: bool = False) -> list[str]:
    """The grams that every text with ``pattern`` has: those of its runs between wildcards."""
    runs = [pattern.strip()] if escape else re.split("[%_]", pattern.strip())
    found = spark.createDataFrame([(r,) for r in runs], "r string").select(F.explode(grams(F.col("r"))).alias("g")).filter(F.length("g") == GRAM)
    return sorted({r["g"] for r in found.collect()})


def search(rows: DataFrame, key: str, columns: list[str], pattern: str, root: str, escape: bool = False, folders: int = FOLDERS) -> DataFrame:
    """``rows`` of which some column contains ``pattern``, as a scan with E.contains_any() finds them: % and _ are wildcards unless escaped, a backslash is itself.

    Keys whose postings have all grams of the pattern are candidates, their texts are checked; ``key`` is unique. Patterns without a run as long as a gram scan.
    """
    holds = E.contains_any([F.col(c) for c in columns], pattern, escape)
    wanted = pattern_grams(rows.sparkSession, pattern, escape)
    if not wanted:
        return rows.filter(holds)
    found = postings(rows.sparkSession, root, wanted, folders).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(wanted))
    return rows.join(found.select(F.col("key").alias("_key")), F.col(key) == F.col("_key"), "left_semi").filter(holds)


def build_pages(rows: DataFrame, order: list[str], root: str, per_part: int = 1_000_000) -> None:
    """``rows`` by ranges of ``order`` (ascending, ending in a unique column) and a directory of the ranges: the number of rows in each and before it."""
    spark = rows.sparkSession
    parts = rows.count() // per_part + 1
    rows.withColumn("_part", F.lit(0)).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(f"{root}/rows")
    spark.createDataFrame([(f"{_schema(rows)}, _part int",)], "value string").coalesce(1).write.text(f"{root}/schema")
    counts = spark.read.schema(f"{_schema(rows)}, _part int").parquet(f"{root}/rows").groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    # One row a range: a window over all of them is small.
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("before", before).coalesce(1).write.parquet(f"{root}/directory")


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def page(spark: SparkSession, root: str, order: list[str], number: int, size: int = 25) -> DataFrame:
    """Page ``number`` (from 1) of what build_pages() wrote: the directory says which ranges it lies in, only these are read and sorted."""
    first, last = (number - 1) * size, number * size
    held = spark.read.parquet(f"{root}/directory").filter((F.col("before") < last) & (F.col("before") + F.col("n") > first)).select("_part", "before").orderBy("_part").collect()
    rows = spark.read.schema(spark.read.text(f"{root}/schema").first()["value"]).parquet(f"{root}/rows").filter(F.col("_part").isin([r["_part"] for r in held]) if held else F.lit(False))
    return rows.drop("_part").orderBy(*order).offset(first - held[0]["before"] if held else 0).limit(size)
