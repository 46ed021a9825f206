"""Counts by dimension, kept up to date from changes.

The state is a table of versions (see sources.versions) with a row for each value of each dimension. A batch of changed rows, as they were before and as they are after, is
folded to +1 and -1 per value, summed in the tasks before anything is shuffled, and merged onto the state: only files that hold a changed value are rewritten. The batch's name goes into the
state in the same commit, so a batch that is sent again, after a failure or by two writers at once, counts once.

Cases: a value may be null; the dimension says what a value is, so equal values of two dimensions don't meet. ``before`` null is an insert, ``after`` null a delete, both null
nothing; a row with the same values before and after changes nothing. Values are counted as text. A count that would fall below zero (a delete of what never was) raises an error before the commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.sources import versions

#: The dimension under which names of batches are kept.
_BATCH = "\x00batch"
#: Names, and what each counts by, as SQL.
Dimensions = dict[str, str]


def _counted(rows: DataFrame, dimensions: Dimensions, sign: Column | int) -> DataFrame:
    """(dimension, value, n): one row per row and dimension, summed."""
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), F.expr(value).cast("string").alias("value")) for name, value in dimensions.items()])
    one = rows.select(F.explode(pairs).alias("p"), (F.lit(sign) if isinstance(sign, int) else sign).cast("long").alias("n"))
    return one.groupBy("p.dimension", "p.value").agg(F.sum("n").alias("n"))


def deltas(changes: DataFrame, dimensions: Dimensions) -> DataFrame:
    """(dimension, value, n) of changes with columns ``before`` and ``after``, structs of a row; values whose sum is zero are left out."""
    side = lambda name, sign: F.col(name).withField("_sign", F.lit(sign))  # noqa: E731  null stays null
    rows = changes.select(F.explode(F.array(side("before", -1), side("after", 1))).alias("_r")).filter("_r is not null").select("_r.*")
    return _counted(rows, dimensions, F.col("_sign")).filter("n <> 0")


def _keyed(counts: DataFrame) -> DataFrame:
    """With the state's key: dimension and value as one text, a null value apart from every other."""
    key = F.concat("dimension", F.when(F.col("value").isNull(), F.lit("\x00")).otherwise(F.concat(F.lit("\x01"), "value")))
    return counts.select(key.alias("key"), "dimension", "value", F.col("n").cast("long").alias("n"))


def create(rows: DataFrame, dimensions: Dimensions, root: str) -> None:
    """The state of a table as it is."""
    versions.create(_keyed(_counted(rows, dimensions, 1)), root, "key")


def apply_deltas(state: DataFrame, change: DataFrame) -> DataFrame:
    """Sums; values that nobody has any more go."""
    out = state.unionByName(change).groupBy("key", "dimension", "value").agg(F.sum("n").alias("n")).filter("n <> 0")
    wrong = F.raise_error(F.concat(F.lit("fewer than none of "), "dimension"))
    return out.withColumn("n", F.when(F.col("n") < 0, wrong.cast("long")).otherwise(F.col("n")))


def update(spark: SparkSession, root: str, batch: str, changes: DataFrame, dimensions: Dimensions) -> bool:
    """Folds a batch into the state; False if a batch of that name is in it already."""
    name = spark.range(1).select(F.lit(_BATCH).alias("dimension"), F.lit(batch).alias("value"), F.lit(1).cast("long").alias("n"))
    change, known = _keyed(deltas(changes, dimensions).unionByName(name)), []

    def apply(state: DataFrame, change: DataFrame) -> DataFrame:
        """The files that were touched hold the batch's name if it came before."""
        known.append(bool(state.filter((F.col("dimension") == _BATCH) & (F.col("value") == batch)).head(1)))
        return state if known[-1] else apply_deltas(state, change)

    versions.merge(spark, root, "key", change, apply)
    return not known[-1]


def counts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(dimension, value, n) of a version, the newest by default."""
    return versions.read(spark, root, version).filter(F.col("dimension") != _BATCH).select("dimension", "value", "n")
