"""Queries on versions, long histories, indexes, pages and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthspark.functions import expr as E
from hearthspark.operators import lookup, membership
from hearthspark.plans.catalog import ORACLES, query
from hearthspark.plans.more import _incoming, _residents
from hearthspark.sources import snapshots, versions
from hearthspark.sources.cuts import fresh_dir
from hearthspark.sources.tables import table

c = F.col


@query("upsert_versioned", sql=ORACLES["upsert_applied"])
def upsert_versioned(spark, d):
    """The upsert as a copy-on-write merge into a table of versions, read back."""
    root = fresh_dir(spark, "versions")
    versions.create(_residents(spark, d), root, "nik")
    versions.merge(spark, root, "nik", _incoming(spark, d), membership.apply_upsert)
    return versions.read(spark, root)


@query("membership_of_any", sql="select event_id, user_id, cast(ts as date) effective_date, cast(lead(ts) over w as date) end_date, case when lead(ts) over w is null then 'AKTIF' else 'KELUAR' end status from events window w as (partition by user_id order by ts, event_id)")
def membership_of_any(spark, d):
    """Membership history where a person may hold any share of the rows."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts")
    return membership.history(rows, "user_id", ["ts", "event_id"], "ts").drop("ts")


@query("indexed_search", sql="select c_custkey, c_name from customer where c_name ilike '%mer#0000000%' or c_mktsegment ilike '%mer#0000000%'")
def indexed_search(spark, d):
    """A substring search by trigrams."""
    rows, root = table(spark, d, "customer"), fresh_dir(spark, "trigrams")
    lookup.build_trigrams(rows, "c_custkey", ["c_name", "c_mktsegment"], root)
    return lookup.search(rows, "c_custkey", ["c_name", "c_mktsegment"], "MER#0000000", root).select("c_custkey", "c_name")


@query("deep_page", sql="select l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (order by l_extendedprice, l_orderkey, l_linenumber) - 1 p, count(*) over () n from lineitem) z where p // 25 = n // 50")
def deep_page(spark, d):
    """The page in the middle of all lines by price."""
    rows, root = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), fresh_dir(spark, "pages")
    order = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    lookup.build_pages(rows, order, root, per_part=20_000)
    return lookup.page(spark, root, order, rows.count() // 50 + 1)


_DIFF = "select c_custkey, case when c_acctbal < 0 then 'removed' else 'changed' end change from customer where c_acctbal < 0 or c_mktsegment = 'BUILDING' union all select -c_custkey, 'added' from customer where c_nationkey = 7"


@query("snapshot_differences", sql=_DIFF)
def snapshot_differences(spark, d):
    """Two snapshots of the households, before and after a change, compared by their hash trees."""
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", c("c_acctbal").cast("decimal(15,2)").alias("c_acctbal"))
    new = old.filter("c_acctbal >= 0").withColumn("c_name", F.when(c("c_mktsegment") == "BUILDING", F.concat("c_name", F.lit("!"))).otherwise(c("c_name")))
    new = new.unionByName(old.filter("c_nationkey = 7").withColumn("c_custkey", -c("c_custkey")))
    a, b = fresh_dir(spark, "snapshot"), fresh_dir(spark, "snapshot")
    snapshots.write(old, "c_custkey", a)
    snapshots.write(new, "c_custkey", b)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in old.schema)
    return snapshots.differences(spark, a, b, schema, "c_custkey")


@query("snapshot_restored", sql="select c_custkey, c_name, c_mktsegment from customer")
def snapshot_restored(spark, d):
    """A snapshot restored over a changed table: buckets that are the same stay, the others come from the snapshot."""
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.filter("c_custkey > 10").withColumn("c_name", F.when(c("c_custkey") == 20, E.slug(c("c_name"))).otherwise(c("c_name")))
    a, b = fresh_dir(spark, "snapshot"), fresh_dir(spark, "snapshot")
    snapshots.write(old, "c_custkey", a)
    snapshots.write(new, "c_custkey", b)
    return snapshots.restored(spark, a, b, "c_custkey bigint, c_name string, c_mktsegment string")
