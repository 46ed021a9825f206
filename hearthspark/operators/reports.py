"""Counts and reports: aggregated first, then filled up with zeros from their dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.functions import expr as E


def domain(spark: SparkSession, values: list, name: str = "value", schema: str = "string") -> DataFrame:
    """A small constant table of a domain's values in order: literals, without Python rows."""
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(v).cast(schema) for v in values])).alias("ord", name)).select(name, "ord")


def count_by_domain(rows: DataFrame, column: str, values: list[str], name: str, total: str = "total") -> DataFrame:
    """Rows of each value of a fixed domain, in its order, with zeros."""
    d = domain(rows.sparkSession, values, name)
    counts = rows.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return d.join(counts, F.col(name) == F.col("_v"), "left").select(name, F.coalesce("_n", F.lit(0)).alias(total), "ord").orderBy("ord").drop("ord")


def count_by_lookup(rows: DataFrame, name: Column, label: str = "name", total: str = "active_count") -> DataFrame:
    """Rows of each name that has any, most first, ties by name."""
    return rows.groupBy(name.alias(label)).agg(F.count(F.lit(1)).alias(total)).orderBy(F.desc(total), label)


def count_by_dimension(rows: DataFrame, key: str, dimension: DataFrame, dim_key: str, keep: list[str], total: str = "total") -> DataFrame:
    """Every row of a dimension with its count, zeros kept."""
    counts = rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return dimension.join(counts, F.col(dim_key) == F.col("_k"), "left").select(*keep, F.coalesce("_n", F.lit(0)).alias(total))


def count_by_rt(residents: DataFrame, rts: DataFrame, areas: DataFrame, key: str = "rt_id") -> DataFrame:
    """(label, active_count) of every RT, in natural order of area and number."""
    dim = rts.select(F.col("id").alias("_rt"), "number", "area_unit_id").join(areas.select(F.col("id").alias("_a"), F.col("label").alias("_area")), F.col("area_unit_id") == F.col("_a"), "left")
    out = count_by_dimension(residents, key, dim, "_rt", ["_area", "number"], "active_count")
    return out.orderBy(E.natural_sort_key(F.col("_area")), E.natural_sort_key(F.col("number"))).select(E.rt_rw_label(F.col("_area"), F.col("number")).alias("label"), "active_count")


def kpi_overview(households: DataFrame, residents: DataFrame, rts: DataFrame, active: Column, unmarried: Column) -> DataFrame:
    """One row: households, active residents, unmarried residents of any status, RTs. One pass over each table."""
    people = residents.agg(F.count_if(active).alias("aktif"), F.count_if(unmarried).alias("unmarried"))
    return households.agg(F.count(F.lit(1)).alias("total_kk")).crossJoin(people).crossJoin(rts.agg(F.count(F.lit(1)).alias("rts")))  # one row each


def recent_activity(feeds: list[tuple[str, DataFrame, str, str]], k: int = 5) -> DataFrame:
    """(kind, id, ts): the ``k`` newest rows of each feed (kind, rows, id, time), newest first."""
    parts = [rows.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col(t).alias("ts")).orderBy(F.desc("ts"), F.desc("id")).limit(k) for kind, rows, i, t in feeds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("ts"), F.desc("id"))


def duplicate_values(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def first_duplicate(rows: DataFrame, value: str, position: str) -> DataFrame:
    """One row: the lowest position at which a value comes for the second time. Two smallest positions per value, by aggregation only."""
    first = rows.groupBy(value).agg(F.min(position).alias("_first"))
    again = rows.join(first, rows[value].eqNullSafe(first[value])).filter(F.col(position) > F.col("_first"))
    return again.agg(F.min(position).alias("first_dup"))
