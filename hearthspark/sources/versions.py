"""Tables in versions, changed by copy-on-write merges.

A version is a manifest, a Parquet table of data files with their row counts and key ranges, and a small file in ``versions`` that names it. A merge finds the files that hold a
changed key, writes these anew with the changes applied, and takes all others over by name. It commits by creating the next number's file, which fails if another
merge took it: the base has moved, and merge() starts again from there. A job that dies leaves files that no version names. Readers hold the version they began with.

Data files lie in ranges of the key, so that a merge of few keys touches few of them; the changed keys' least and greatest prune files before any is opened.

Cases: rows with a null key are in no range and are read by every merge; changes of no rows commit nothing; a table of no rows has a version with no files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.sources.cuts import create_once, cut, names

#: Rows of a data file.
FILE_ROWS = 1_000_000
Apply = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has committed since the base version."""


def latest(spark: SparkSession, root: str) -> int | None:
    """The newest version's number; None if there is no table."""
    return max(map(int, names(spark, f"{root}/versions")), default=None)


def files(spark: SparkSession, root: str, version: int) -> DataFrame:
    """(path, n, lo, hi) of a version's data files; paths are relative to ``root``."""
    return spark.read.parquet(spark.read.text(f"{root}/versions/{version:010d}").first()["value"])


def _listed(spark: SparkSession, root: str, schema: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default. The driver holds its file names."""
    number = latest(spark, root) if version is None else version
    if number is None:
        raise FileNotFoundError(f"no table at {root}")
    schema = spark.read.text(f"{root}/schema").first()["value"]
    return _listed(spark, root, schema, [r["path"] for r in files(spark, root, number).select("path").collect()])


def _relative(root: str):
    """The file a row was read from, as manifests name it."""
    return F.regexp_extract("_metadata.file_path", r"data/[^/]+/[^/]+$", 0)


def _written(rows: DataFrame, root: str, key: str, file_rows: int) -> DataFrame:
    """Writes data files in ranges of the key; gives their manifest entries."""
    import uuid

    spark, path = rows.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    rows = cut(rows)
    rows.repartitionByRange(rows.count() // file_rows + 1, key).write.parquet(path)
    made = spark.read.schema(rows.schema).parquet(path).groupBy(_relative(root).alias("path"))
    return made.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))


def _commit(entries: DataFrame, root: str, number: int) -> None:
    """Writes the manifest, then takes the number."""
    import uuid

    spark, path = entries.sparkSession, f"{root}/manifests/{number:010d}-{uuid.uuid4().hex}"
    entries.coalesce(1).write.parquet(path)
    if not create_once(spark, f"{root}/versions/{number:010d}", path):
        raise Conflict(f"version {number} of {root} is taken")


def create(rows: DataFrame, root: str, key: str, file_rows: int = FILE_ROWS) -> int:
    """Version 0 of a table."""
    spark = rows.sparkSession
    if not create_once(spark, f"{root}/schema", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)):
        raise Conflict(f"there is a table at {root}")
    _commit(_written(rows, root, key, file_rows), root, 0)
    return 0


def merge_onto(spark: SparkSession, root: str, key: str, changes: DataFrame, apply: Apply, base: int, file_rows: int = FILE_ROWS) -> int:
    """One try of merge() onto version ``base``; Conflict if that isn't the newest any more."""
    changes = cut(changes)
    reach = changes.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not reach["n"]:
        return base
    entries = files(spark, root, base)
    schema = spark.read.text(f"{root}/schema").first()["value"]
    # Files without a key range hold null keys only.
    near = entries.filter(F.col("lo").isNull() | ((F.col("hi") >= F.lit(reach["lo"])) & (F.col("lo") <= F.lit(reach["hi"])))) if reach["lo"] is not None else entries
    scanned = _listed(spark, root, schema, [r["path"] for r in near.select("path").collect()])
    if scanned.inputFiles():
        keyed = scanned.select(F.col(key).alias("_key"), _relative(root).alias("path"))
        touched = [r["path"] for r in keyed.join(changes, keyed["_key"].eqNullSafe(changes[key]), "left_semi").select("path").distinct().collect()]
    else:
        touched = []
    new = _written(apply(_listed(spark, root, schema, touched), changes), root, key, file_rows)
    kept = entries.filter(~F.col("path").isin(touched)) if touched else entries
    _commit(kept.unionByName(new), root, base + 1)
    return base + 1


def merge(spark: SparkSession, root: str, key: str, changes: DataFrame, apply: Apply, tries: int = 5, file_rows: int = FILE_ROWS) -> int:
    """Applies ``changes`` to the newest version and commits the next; gives its number. ``apply`` (rows, changes) gives the rows of the files that hold a changed key, and new ones.

    Where another writer was first, it starts again on what that one committed.
    """
    for _ in range(tries):
        base = latest(spark, root)
        if base is None:
            raise FileNotFoundError(f"no table at {root}")
        try:
            return merge_onto(spark, root, key, changes, apply, base, file_rows)
        except Conflict:
            continue
    raise Conflict(f"{root} has moved {tries} times")
