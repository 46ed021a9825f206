"""Incremental snapshots: hash trees over buckets of keys.

A snapshot's rows lie in buckets of their key's hash. Each bucket has a checksum, each run of FAN buckets one of its buckets' checksums, and so on to a single root. Two snapshots are
compared from the root down, and only below nodes that differ, so equal tables are known by one row each, and a difference or a restore reads only the buckets it lies in.
The number of buckets is the writer's; snapshots to be compared need the same.

Cases: rows with null keys have a bucket like any other, repeated rows count; an empty table has a tree without nodes, which differs from any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.sources.cuts import cut
from hearthspark.sources.exports import checksum

BUCKETS, FAN = 64, 8


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def hash_tree(rows: DataFrame, bucket: str = "bucket", buckets: int = BUCKETS, fan: int = FAN) -> DataFrame:
    """(level, node, n, checksum): level 0 has the buckets with rows, the last level one node."""
    at = cut(checksum(rows, [bucket]).select(F.lit(0).alias("level"), F.col(bucket).cast("int").alias("node"), "n", "checksum"))
    out, size, level = at, buckets, 0
    while size > 1:
        size, level = -(-size // fan), level + 1
        part = F.xxhash64("node", "n", "checksum").cast("decimal(38,0)")
        at = at.groupBy(F.floor(F.col("node") / fan).cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sum(part).cast("string").alias("checksum")).select(F.lit(level).alias("level"), "node", "n", "checksum")
        out = out.unionByName(at)
    return out


def write(rows: DataFrame, key: str, root: str, buckets: int = BUCKETS) -> None:
    """Rows by bucket, and the tree of what was written; the tree comes last, so a folder without one is no snapshot."""
    spark = rows.sparkSession
    marked = rows.withColumn("bucket", bucket_of(key, buckets))
    marked.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{root}/rows")
    back = spark.read.schema(marked.schema).parquet(f"{root}/rows")
    hash_tree(back, "bucket", buckets).coalesce(1).write.parquet(f"{root}/tree")


def tree(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/tree")


def differing(spark: SparkSession, a: str, b: str, fan: int = FAN) -> list[int]:
    """Buckets in which two snapshots differ, found from the root down; the driver holds the numbers of the nodes that differ."""
    met = tree(spark, a).select("level", "node", F.struct("n", "checksum").alias("a")).join(tree(spark, b).select("level", "node", F.struct("n", "checksum").alias("b")), ["level", "node"], "full")
    other = met.filter(~F.col("a").eqNullSafe(F.col("b")))
    top = max((r[0] or 0 for r in (tree(spark, x).agg(F.max("level")).first() for x in (a, b))), default=0)
    nodes = [r["node"] for r in other.filter(F.col("level") == top).select("node").collect()]
    for level in range(top - 1, -1, -1):
        if nodes:
            below = other.filter((F.col("level") == level) & F.floor(F.col("node") / fan).cast("int").isin(nodes))
            nodes = [r["node"] for r in below.select("node").collect()]
    return sorted(nodes)


def bucket_rows(spark: SparkSession, root: str, schema: str, buckets: list[int]) -> DataFrame:
    """Rows of some buckets; other folders aren't read."""
    return spark.read.schema(f"{schema}, bucket int").parquet(f"{root}/rows").filter(F.col("bucket").isin(buckets) if buckets else F.lit(False)).drop("bucket")


def differences(spark: SparkSession, old: str, new: str, schema: str, key: str) -> DataFrame:
    """(key, change) of distinct keys: added, removed or changed from one snapshot to the other, from the differing buckets alone."""
    where = differing(spark, old, new)
    h = F.xxhash64(*[F.col(f).cast("string") for f in sorted(spark.createDataFrame([], schema).columns)]).alias("_h")
    a = bucket_rows(spark, old, schema, where).select(F.col(key).alias("_a"), h.alias("_ha"))
    b = bucket_rows(spark, new, schema, where).select(F.col(key).alias("_b"), h.alias("_hb"))
    met = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full")
    change = F.when(F.col("_ha").isNull(), "added").when(F.col("_hb").isNull(), "removed").when(F.col("_ha") != F.col("_hb"), "changed")
    return met.select(F.coalesce("_a", "_b").alias(key), change.alias("change")).filter("change is not null")


def restored(spark: SparkSession, snapshot: str, now: str, schema: str) -> DataFrame:
    """The snapshot's rows: of buckets that are still the same as ``now`` has them, of others as the snapshot has them."""
    where = differing(spark, snapshot, now)
    same = spark.read.schema(f"{schema}, bucket int").parquet(f"{now}/rows").filter(~F.col("bucket").isin(where) if where else F.lit(True)).drop("bucket")
    return same.unionByName(bucket_rows(spark, snapshot, schema, where))
