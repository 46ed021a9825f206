"""Membership history and planned changes. Plans are DataFrames; a table is replaced by writing a new snapshot of it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspark.sources.cuts import cut

#: What an import does with a resident who is known already.
MODES = ("reject", "move_active", "force_active")


def following(rows: DataFrame, person: str, order: list[str], value: str, name: str, per_task: int = 1_000_000) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the person's next row, null after the last one. Unlike lead() by person, a person may hold any share of the rows.

    Rows are dealt out by ranges of (person, order), lead() works inside a range, and the last row of a person in a range takes the first of that person's next range; of these first rows
    there is one per person and range. ``order`` should end in a column that makes it unique; a null person is a person.
    """
    parts = max(rows.count() // per_task + 1, rows.sparkSession.sparkContext.defaultParallelism)
    keyed = rows.withColumn("_range", F.lit(0)).repartitionByRange(parts, person, *order)
    ranged = cut(keyed.withColumn("_range", F.spark_partition_id()))  # cut, so that ranges stay as they are whoever reads them
    inside = F.lead(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(person, "_range").orderBy(*order))
    first = ranged.groupBy(person, "_range").agg(F.min(F.struct(*order, F.col(value).alias("_v")))["_v"].alias("_v"))
    split = first.groupBy(F.col(person).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    ends = first.join(split, F.col(person).eqNullSafe(F.col("_p")), "left_semi")
    ends = ends.select(F.col(person).alias("_p"), F.col("_range").alias("_r"), F.lead(F.struct(F.col("_v").alias("v"))).over(Window.partitionBy(person).orderBy("_range")).alias("_next"))
    met = ranged.withColumn("_inside", inside).join(ends, F.col(person).eqNullSafe(F.col("_p")) & (F.col("_range") == F.col("_r")), "left")
    return met.select(*rows.columns, F.coalesce("_inside", "_next")["v"].alias(name))


def history(events: DataFrame, person: str, order: list[str], when: str, per_task: int = 1_000_000) -> DataFrame:
    """``effective_date``, ``end_date`` and ``status`` of each membership: one ends where the person's next begins. A person may hold any share of the rows (see following)."""
    rows = following(events, person, order, when, "_following", per_task)
    status = F.when(F.col("_following").isNull(), "AKTIF").otherwise("KELUAR")
    return rows.withColumn("effective_date", F.col(when).cast("date")).withColumn("end_date", F.col("_following").cast("date")).withColumn("status", status).drop("_following")


def upsert_plan(incoming: DataFrame, known: DataFrame, mode: str = "move_active") -> DataFrame:
    """(nik, action) for ``incoming`` (nik, kk_id) against ``known`` (nik, kk_id, active).

    reject: INSERT or DUPLICATE. move_active: INSERT, REJECT_INACTIVE, KEEP or MOVE. force_active: INSERT or MOVE_AND_ACTIVATE.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    k = known.select(F.col("nik").alias("_nik"), F.col("kk_id").alias("_kk"), F.col("active").alias("_active"))
    met = incoming.join(k, F.col("nik") == F.col("_nik"), "left")
    new = F.when(F.col("_nik").isNull(), "INSERT")
    action = {
        "reject": new.otherwise("DUPLICATE"),
        "move_active": new.when(~F.col("_active"), "REJECT_INACTIVE").when(F.col("_kk") == F.col("kk_id"), "KEEP").otherwise("MOVE"),
        "force_active": new.otherwise("MOVE_AND_ACTIVATE"),
    }[mode]
    return met.select("nik", action.alias("action"))


def apply_moves(memberships: DataFrame, moves: DataFrame, on: date) -> DataFrame:
    """Memberships after ``moves`` (penduduk_id, kk_id, family_relation) of a day, one per person.

    Active rows of other households are closed with that day; an active row of the same household stays open with the move's relation (of several, the one of the lowest id;
    the others are closed); without one a new row is opened. New rows have no id yet.
    """
    m = moves.select(F.col("penduduk_id").alias("_p"), F.col("kk_id").alias("_kk"), F.col("family_relation").alias("_rel"))
    active, there = F.col("status") == "AKTIF", (F.col("penduduk_id") == F.col("_p")) & (F.col("kk_id") == F.col("_kk"))
    kept = memberships.filter(active).join(m, there).groupBy("penduduk_id").agg(F.min(F.struct("id")).alias("_first")).withColumnRenamed("penduduk_id", "_done")
    m = m.join(kept, F.col("_p") == F.col("_done"), "left").drop("_done")
    rows = memberships.join(m, F.col("penduduk_id") == F.col("_p"), "left")
    rows = rows.withColumn("_keep", F.coalesce(active & (F.col("kk_id") == F.col("_kk")) & (F.struct("id") == F.col("_first")), F.lit(False)))
    rows = rows.withColumn("_close", F.coalesce(F.col("_p").isNotNull() & active & ~F.col("_keep"), F.lit(False)))
    changed = rows.select(
        "id", "kk_id", "penduduk_id", F.when(F.col("_keep"), F.col("_rel")).otherwise(F.col("family_relation")).alias("family_relation"),
        F.when(F.col("_close"), "KELUAR").otherwise(F.col("status")).alias("status"), "effective_date",
        F.when(F.col("_close"), F.lit(on)).when(F.col("_keep"), F.lit(None)).otherwise(F.col("end_date")).alias("end_date"),
    )
    fresh = m.filter("_first is null").select(
        F.lit(None).cast("long").alias("id"), F.col("_kk").alias("kk_id"), F.col("_p").alias("penduduk_id"), F.col("_rel").alias("family_relation"),
        F.lit("AKTIF").alias("status"), F.lit(on).alias("effective_date"), F.lit(None).cast("date").alias("end_date"),
    )
    return changed.unionByName(fresh)


def apply_upsert(known: DataFrame, incoming: DataFrame, reactivate: bool = False) -> DataFrame:
    """The residents (nik, kk_id, resident_status, moved_at) after ``incoming`` (nik, kk_id; distinct niks): new ones are inserted as active, known active ones move to the incoming
    household, inactive ones are left as they are; with ``reactivate`` they move too, become active and lose their moved_at."""
    i = incoming.select(F.col("nik").alias("_nik"), F.col("kk_id").alias("_kk"))
    met = known.join(i, F.col("nik") == F.col("_nik"), "full")
    takes = F.col("_nik").isNotNull() & (F.col("nik").isNull() | (F.col("resident_status") == "ACTIVE") | F.lit(reactivate))
    return met.select(
        F.coalesce("nik", "_nik").alias("nik"), F.when(takes, F.col("_kk")).otherwise(F.col("kk_id")).alias("kk_id"), F.when(takes, "ACTIVE").otherwise(F.col("resident_status")).alias("resident_status"),
        F.when(takes & (F.col("nik").isNull() | F.lit(reactivate)), F.lit(None)).otherwise(F.col("moved_at")).alias("moved_at"),
    )


def taken_niks(edits: DataFrame, known: DataFrame) -> DataFrame:
    """``edits`` (id, nik) that would take the NIK of another resident of ``known`` (id, nik)."""
    k = known.select(F.col("id").alias("_id"), F.col("nik").alias("_nik"))
    return edits.join(k, (F.col("nik") == F.col("_nik")) & (F.col("id") != F.col("_id")), "left_semi")


def import_rows(rows: DataFrame, batch: str, invalid: Column) -> DataFrame:
    """The rows to write of batches without an invalid row; batches with one give none."""
    bad = rows.filter(F.coalesce(invalid, F.lit(False))).select(F.col(batch).alias("_b")).distinct()
    return rows.join(bad, F.col(batch) == F.col("_b"), "left_anti")


def replace_active(versions: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``versions`` (keys, id, is_active, ...) after ``fresh`` ones of the same columns: what was active for their keys is archived, they are active."""
    new = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_new", F.lit(True))
    cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    old = versions.join(new, cond, "left").withColumn("is_active", F.col("is_active") & F.col("_new").isNull())
    return old.select(*versions.columns).unionByName(fresh.withColumn("is_active", F.lit(True)).select(*versions.columns))


def import_plan(rows: DataFrame, batch: str, invalid: Column) -> DataFrame:
    """(batch, st, n): all-or-nothing, a batch with an invalid row is INVALID as a whole."""
    return rows.groupBy(batch).agg(F.when(F.count_if(invalid) > 0, "INVALID").otherwise("SAVED").alias("st"), F.count(F.lit(1)).alias("n"))


def duplicate_in_import(batch: DataFrame, known: DataFrame) -> DataFrame:
    """(batch_id, duplicate_nik): of ``batch`` (batch_id, idx, nik) the first nik that repeats, else the first that is known; batches without one are left out."""
    places = batch.groupBy(F.col("batch_id").alias("_b"), F.col("nik").alias("_n"), "idx").agg(F.count(F.lit(1)).alias("_same"))  # places may repeat
    first = places.groupBy("_b", "_n").agg(F.min(F.struct("idx", "_same")).alias("_first"))
    rows = batch.join(first, F.col("batch_id").eqNullSafe(F.col("_b")) & F.col("nik").eqNullSafe(F.col("_n"))).withColumn("_again", (F.col("idx") > F.col("_first.idx")) | (F.col("_first._same") > 1))
    k = known.select(F.col("nik").alias("_k")).distinct()
    rows = rows.join(k, F.col("nik") == F.col("_k"), "left")
    out = rows.groupBy("batch_id").agg(F.min_by("nik", F.when(F.col("_again"), F.col("idx"))).alias("_r"), F.min_by("nik", F.when(F.col("_k").isNotNull(), F.col("idx"))).alias("_e"))
    return out.select("batch_id", F.coalesce("_r", "_e").alias("duplicate_nik")).filter("duplicate_nik is not null")


def not_yet_imported(jobs: DataFrame, json: str, path: str = "$.penduduk_imported_at") -> DataFrame:
    """Jobs whose snapshot lacks the mark of an import."""
    return jobs.filter(F.get_json_object(json, path).isNull())
