"""Joined and latest-row views of the registry. Lookup tables are small; Spark broadcasts them by their measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspark.functions import expr as E
from hearthspark.sources.cuts import cut


def resident_view(residents: DataFrame, households: DataFrame, rts: DataFrame, areas: DataFrame, lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    """Residents with their household's number and area (the household's, not a cached one) and the names of lookups."""
    h = households.select(F.col("id").alias("_h"), "kk_number", F.col("rt_id").alias("_rt"))
    r = rts.select(F.col("id").alias("_r"), F.col("number").alias("rt_number"), F.col("area_unit_id").alias("area_unit_id"))
    a = areas.select(F.col("id").alias("_a"), F.col("name").alias("area_name"), F.col("type").alias("area_type"), F.col("code").alias("area_code"))
    out = residents.drop("rt_id").join(h, residents["kk_id"] == h["_h"], "left").join(r, F.col("_rt") == F.col("_r"), "left").join(a, F.col("area_unit_id") == F.col("_a"), "left")
    out = out.withColumn("rt_id", F.col("_rt"))
    for name, table in (lookups or {}).items():
        t = table.select(F.col("id").alias(f"_{name}"), F.col("name").alias(name))
        out = out.join(t, F.col(f"{name}_id") == F.col(f"_{name}"), "left").drop(f"_{name}")
    return out.drop("_h", "_rt", "_r", "_a")


def latest_per(rows: DataFrame, keys: list[str], order: list, where: Column | None = None) -> DataFrame:
    """The first row of each key in an order; the rank's limit is applied before the shuffle too."""
    rows = rows.filter(where) if where is not None else rows
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def head_of_household(residents: DataFrame, key: str = "kk_id", id_: str = "id", is_head: Column | None = None) -> DataFrame:
    """(key, head): the head of the largest id. One aggregate with map-side combining, no sort."""
    where = is_head if is_head is not None else F.col("family_relation") == "KEPALA_KELUARGA"
    return residents.filter(where).groupBy(key).agg(F.max(id_).alias("head"))


def active_version(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Rows with ``is_active``: whether a row is the newest of its key, by an aggregate that combines in tasks. Ids are distinct; a row without one isn't active."""
    newest = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(id_).alias("_newest"))
    met = rows.join(newest, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return met.select(*rows.columns, F.coalesce(F.col(id_) == F.col("_newest"), F.lit(False)).alias("is_active"))


def first_occurrences(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; later ones are duplicates."""
    return latest_per(rows, keys, order)


def child_count(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str = "n") -> DataFrame:
    """Parents with the number of their children: aggregated before the join."""
    counts = children.groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return parents.join(counts, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_k", "_n")


def delete_guard(parents: DataFrame, key: str, guards: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(key, verdict): the name of the first guard (name, children, child key) with rows, else DELETABLE."""
    verdict, out = F.lit("DELETABLE"), parents.select(key)
    for i, (name, children, child_key) in reversed(list(enumerate(guards))):
        out = child_count(out, children, key, child_key, f"_g{i}")
        verdict = F.when(F.col(f"_g{i}") > 0, name).otherwise(verdict)
    return out.select(key, verdict.alias("verdict"))


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: list[str], name: str = "members") -> DataFrame:
    """Parents with their children as a sorted array of structs."""
    lists = children.groupBy(F.col(child_key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, F.col(key) == F.col("_k"), "left").drop("_k")


def morph_join(logs: DataFrame, targets: DataFrame, kind: str, type_col: str, id_col: str, target_key: str) -> DataFrame:
    """Polymorphic join: the logs of one type with the rows they are about."""
    return logs.filter(F.col(type_col) == kind).join(targets, F.col(id_col) == F.col(target_key))


def conflicts(rows: DataFrame, value: Column, id_: str) -> DataFrame:
    """Pairs (a, b), a < b, of rows with the same value: each further row with the first, so a value's rows give pairs in proportion to their number. The first is found by
    an aggregate over the value's digest, which combines in tasks; a value of very many rows meets it in a join that Spark can split."""
    keyed = rows.select(F.col(id_).alias("b"), F.sha2(value.cast("string"), 256).alias("_h")).filter("_h is not null")
    first = keyed.groupBy("_h").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return keyed.join(first, "_h").filter(F.col("a") < F.col("b")).select("a", "b")


def lookup_ids(rows: DataFrame, names: DataFrame, text: Column, name: str = "name", id_: str = "id") -> DataFrame:
    """Rows with the id of a lookup name, both normalized; rows without one are left out."""
    n = names.select(E.normalized_key(F.col(name)).alias("_n"), F.col(id_))
    return rows.withColumn("_key", E.normalized_key(text)).join(n, F.col("_key") == F.col("_n")).drop("_key", "_n")


def new_names(incoming: DataFrame, known: DataFrame, name: str = "name", known_name: str = "name") -> DataFrame:
    """Names of ``incoming`` that the lookup lacks."""
    return incoming.select(name).distinct().join(known.select(F.col(known_name).alias("_k")), F.col(name) == F.col("_k"), "left_anti")


def grow_dimension(names: DataFrame, incoming: DataFrame) -> DataFrame:
    """A lookup (id, name) with the missing names of ``incoming`` (name) in title case, numbered on."""
    first = incoming.select(E.title_case(E.trim_ws(F.col("name"))).alias("name"), E.normalized_key(F.col("name")).alias("_k")).filter("_k <> ''").dropDuplicates(["_k"])
    fresh = first.join(names.select(E.normalized_key(F.col("name")).alias("_k")), "_k", "left_anti")
    top = names.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = numbered_by(fresh, "_k", "_rn").crossJoin(F.broadcast(top))  # one row
    return names.unionByName(numbered.select((F.col("top") + F.col("_rn")).cast("long").alias("id"), "name"))


def numbered_by(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` numbered from 1 in the order of a distinct key: in ranges of it, each with the number of rows before it. No task holds all rows."""
    ranged = cut(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("_part").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn("_inside", inside).join(starts, F.col("_part") == F.col("_at")).select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))


def backfill_area(households: DataFrame, members: DataFrame, key: str, child_key: str, id_: str, is_head: Column, value: Column) -> DataFrame:
    """(key, rt): the newest head's value, else that of the lowest member id with one. One aggregate over the members."""
    per = members.groupBy(F.col(child_key).alias("_k")).agg(F.max_by(F.when(is_head, value), F.when(is_head, F.col(id_))).alias("_h"), F.min_by(value, F.when(value.isNotNull(), F.col(id_))).alias("_m"))
    return households.join(per, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_h", "_m").alias("rt"))


def corrected(base: DataFrame, corrections: DataFrame, key: str, correction_key: str, columns: dict[str, str]) -> DataFrame:
    """``base`` with the columns that a correction has; ``columns``: its column for each of the base's."""
    c = corrections.select(F.col(correction_key).alias("_k"), *[F.col(v).alias(f"_c_{k}") for k, v in columns.items()])
    out = base.join(c, F.col(key) == F.col("_k"), "left")
    for name in columns:
        out = out.withColumn(name, F.coalesce(f"_c_{name}", name))
    return out.select(*base.columns)


def settings_or_default(defaults: DataFrame, stored: DataFrame, key: str, value: str, stored_key: str, stored_value: str) -> DataFrame:
    """Stored settings where there are any, defaults else."""
    s = stored.select(F.col(stored_key).alias("_k"), F.col(stored_value).alias("_v"))
    return defaults.join(s, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_v", value).alias(value))
