"""Helpers that several operators share: row keys and joins that survive hot keys. Lineage cuts and folders are those of the whole library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspark.sources.cuts import cut, fresh_dir, remove, shared_dir, written

__all__ = ["bound", "cut", "fresh_dir", "lower_ascii", "merged", "numbered", "remove", "running", "shared_dir", "spread_lookup", "without", "written"]

#: Elements of an array that are combined at a time.
BLOCK = 256
#: A lookup table of at most so many bytes (as measured) is broadcast.
SMALL = 8 << 20
#: Most rows of one key that one task of a lookup should meet.
PER_TASK = 100_000
#: Bound on the keys that are split, whatever the input: a key with a smaller share of all rows never is.
MOST_HOT = 100_000


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row key ``name`` that stays the same whenever it is read.

    Rows of a Parquet scan have one: their file and their place in it. Any other frame is written to the shared folder first.
    """
    key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return df.select("*", key.alias(name))
    except AnalysisException:
        return written(df, "rows").select("*", key.alias(name))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; all-ASCII texts take the faster built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(xs: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """Before each element of ``xs``, its predecessors' values (ints) combined.

    Appending to an array copies it, so elements are combined in blocks, and blocks' totals across them: n elements cost n (BLOCK + n / BLOCK / BLOCK) copies, not n * n.
    """
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / BLOCK).cast("int"), F.lit(0)))
    part = lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))
    start = lambda at: F.struct(at.cast("int").alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    step = lambda acc, v: F.struct(combine(acc["at"], v).cast("int").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(zero), lambda acc, x: combine(acc, value(x)).cast("int")))
    offsets = F.aggregate(totals, start(F.lit(zero)), step, lambda acc: acc["out"])
    return bound(offsets, lambda at: F.flatten(F.transform(blocks, lambda b: F.aggregate(part(b), start(F.get(at, b)), lambda acc, x: step(acc, value(x)), lambda acc: acc["out"]))))


def merged(spans: Column, touching: bool) -> Column:
    """Unions (s, e) of overlapping spans, sorted by start, and of those that touch if ``touching``."""
    before = running(spans, lambda x: x["e"], F.greatest, -1)
    new = lambda x, reach: (x["s"] > reach) if touching else (x["s"] >= reach)

    def unions(reach: Column) -> Column:
        starts = F.filter(F.transform(spans, lambda x, i: F.when(new(x, F.get(reach, i)), i)), lambda i: i.isNotNull())
        most = F.array_max(F.transform(spans, lambda x: x["e"]))
        end = lambda at, j: F.coalesce(F.get(reach, F.get(at, j + 1)), most)
        return bound(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(spans, i)["s"].alias("s"), end(at, j).alias("e"))))

    return F.when(F.size(spans) > 0, bound(before, unions)).otherwise(F.expr("cast(array() as array<struct<s:int,e:int>>)"))


def spread_lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: str, values: list[str], small: int = SMALL, per_task: int = PER_TASK) -> DataFrame:
    """Left join of ``left`` with ``right``, whose keys are unique; rows of ``left`` are kept, each once.

    ``right`` is measured first: up to ``small`` bytes it is broadcast. Beyond, both sides are shuffled by key and salt. ``weight`` (in ``right``) is the
    number of rows the key has in ``left``; a key that outweighs a task's share is hot, its rows are dealt out by ``spread`` over
    as many salts as it fills shares, and its one row of ``right`` is repeated for each. Of hot keys only hashes and salts are broadcast: a share is at least
    1/MOST_HOT of all rows, so there are at most MOST_HOT of them. Rows with a null key match nothing and are dealt out too.
    ``right`` should be cut: it is read several times.
    """
    size = F.octet_length(F.to_json(F.struct(key, *values))) + 32
    facts = right.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.sum(weight).alias("rows")).first()
    found = right.select(F.col(key).alias("_k"), F.col(weight).alias("_w"), *[F.col(v).alias(f"_v_{v}") for v in values])
    out = [*left.columns, *[F.col(f"_v_{v}").alias(v) for v in values]]
    if (facts["bytes"] or 0) <= small:
        return left.join(F.broadcast(found.drop("_w")), F.col(key) == F.col("_k"), "left").select(*out)
    share = max(min(per_task, facts["rows"] // 1000), facts["rows"] // MOST_HOT, 1)
    salts = F.ceil(F.col("_w") / share).cast("int")
    hot = F.broadcast(cut(found.filter(salts > 1).groupBy(F.xxhash64("_k").alias("_hot")).agg(F.max(salts).alias("_salts"))))
    found = found.join(hot, F.xxhash64("_k") == F.col("_hot"), "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_w", "_hot", "_salts")
    rows = left.join(hot, F.xxhash64(key) == F.col("_hot"), "left")
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 30)).cast("int")).otherwise(F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int"))
    rows = rows.withColumn("_salt", salt)
    return rows.join(found, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left").select(*out)


def without(rows: DataFrame, gone: DataFrame, key: str, small: int = SMALL) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone`` (one column, cut). If that is at most ``small`` bytes, at 64 a row, it is broadcast, so that rows stay where they are."""
    return rows.join(F.broadcast(gone) if gone.count() * 64 <= small else gone, key, "left_anti")
