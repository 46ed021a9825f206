"""Query catalogue: each key names a query of the registry engine, run on the driver's analog tables, with its oracle in SQL.

Analogs: customer is the household, orders the resident (o_orderkey its number, o_orderstatus O/P/F its status, o_orderpriority 1-URGENT the
head), nation the RT, region the area, events the history, documents, pages and conversations the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.functions import expr as E
from hearthspark.operators import filters, membership, quality, reports, views
from hearthspark.operators.household_text import parse_households
from hearthspark.sources.cuts import fresh_dir
from hearthspark.sources.exports import archive_errors, file_inventory, snapshot_manifest, write_csv
from hearthspark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = date(2010, 3, 1)
STATUS = {"O": "Aktif", "P": "Pindah", "F": "Meninggal"}
c = F.col


def query(*names: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its names, with its oracle."""

    def add(f: Query) -> Query:
        for name in names:
            QUERIES[name] = f
            if sql:
                ORACLES[name] = sql
        return f

    return add


def born(orders: DataFrame) -> DataFrame:
    return orders.withColumn("birth_date", c("o_orderdate").cast("date"))


def located(rows: DataFrame, spark: SparkSession, d: str, key: str = "c_nationkey") -> DataFrame:
    """With RT and area, where there are any."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return rows.join(n, c(key) == n["n_nationkey"], "left").join(r, c("n_regionkey") == r["r_regionkey"], "left")


def residents_located(spark: SparkSession, d: str) -> DataFrame:
    o, h = table(spark, d, "orders"), table(spark, d, "customer")
    return located(o.join(h, o["o_custkey"] == h["c_custkey"], "left"), spark, d)


# Counts and reports


@query("kpi_overview", sql="select (select count(*) from customer) total_kk,(select count(*) from orders where o_orderstatus='O') aktif,(select count(*) from orders where o_orderpriority='5-LOW') unmarried,(select count(*) from nation) rts")
def kpi_overview(spark, d):
    return reports.kpi_overview(table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "nation"), c("o_orderstatus") == "O", c("o_orderpriority") == "5-LOW")


@query("count_by_status", sql="select e.v status, count(o.o_orderkey) total from (values ('O'),('P'),('F'),('X')) e(v) left join orders o on o.o_orderstatus=e.v group by e.v")
def count_by_status(spark, d):
    return reports.count_by_domain(table(spark, d, "orders"), "o_orderstatus", ["O", "P", "F", "X"], "status")


@query("count_by_religion", sql="select c_mktsegment name, count(*) active_count from customer where c_acctbal>0 group by c_mktsegment order by active_count desc, name")
def count_by_lookup(spark, d):
    return reports.count_by_lookup(table(spark, d, "customer").filter("c_acctbal > 0"), c("c_mktsegment"))


@query("count_by_area", sql="select r.r_name, coalesce(x.total,0) total from region r left join (select n.n_regionkey k, count(*) total from customer c join nation n on c.c_nationkey=n.n_nationkey where c_mktsegment='BUILDING' group by n.n_regionkey) x on x.k=r.r_regionkey")
def count_by_area(spark, d):
    n = table(spark, d, "nation")
    h = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").join(n, c("c_nationkey") == n["n_nationkey"])
    return reports.count_by_dimension(h, "n_regionkey", table(spark, d, "region"), "r_regionkey", ["r_name"]).orderBy("r_name")


@query("count_by_rt", sql="select concat(r_name,' / RT ',n_name) as label, count(c.c_custkey) active_count from nation n join region r on r.r_regionkey=n.n_regionkey left join customer c on c.c_nationkey=n.n_nationkey and c.c_mktsegment='BUILDING' and c.c_acctbal<500 group by r_name,n_name")
def count_by_rt(spark, d):
    rts = table(spark, d, "nation").select(c("n_nationkey").alias("id"), c("n_name").alias("number"), c("n_regionkey").alias("area_unit_id"))
    areas = table(spark, d, "region").select(c("r_regionkey").alias("id"), c("r_name").alias("label"))
    return reports.count_by_rt(table(spark, d, "customer").filter("c_mktsegment = 'BUILDING' and c_acctbal < 500"), rts, areas, "c_nationkey")


@query("member_count", sql="select c.c_custkey, count(o.o_orderkey) n from customer c left join orders o on o.o_custkey=c.c_custkey and o.o_orderstatus='O' group by c.c_custkey order by n desc, c.c_custkey")
def member_count(spark, d):
    out = views.child_count(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_orderstatus = 'O'"), "c_custkey", "o_custkey")
    return out.orderBy(F.desc("n"), "c_custkey")


@query("history_count", sql="select c.c_custkey, count(e.event_id) n from customer c join events e on e.user_id=c.c_custkey group by c.c_custkey")
def history_count(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(counts, c("c_custkey") == c("user_id")).select("c_custkey", "n")


@query("delete_guard", sql="select c.c_custkey, case when coalesce(m.n,0)>0 then 'MEMBERS' when coalesce(h.n,0)>0 then 'HISTORY' else 'DELETABLE' end verdict from customer c left join (select o_custkey k,count(*) n from orders where o_totalprice>480000 group by o_custkey) m on m.k=c.c_custkey left join (select user_id k,count(*) n from events group by user_id) h on h.k=c.c_custkey")
def delete_guard(spark, d):
    return views.delete_guard(table(spark, d, "customer"), "c_custkey", [("MEMBERS", table(spark, d, "orders").filter("o_totalprice > 480000"), "o_custkey"), ("HISTORY", table(spark, d, "events"), "user_id")])


@query("has_members_flag", sql="select c_custkey, exists(select 1 from orders o where o.o_custkey=c.c_custkey and o.o_totalprice>480000) f from customer c")
def has_members_flag(spark, d):
    return filters.flag_with(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_totalprice > 480000"), "c_custkey", "o_custkey", "f")


@query("duplicate_keys", sql="select text, count(*) n from documents group by text having count(*)>1")
def duplicate_keys(spark, d):
    return reports.duplicate_values(table(spark, d, "documents"), "text")


@query("first_duplicate", sql="select min(doc_id) first_dup from (select doc_id,row_number() over(partition by text order by doc_id) rn from documents) z where rn=2")
def first_duplicate(spark, d):
    return reports.first_duplicate(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "h", "doc_id")


@query("mean_confidence", sql="select o_custkey, cast(floor((2*sum(cast(round(o_totalprice*100) as bigint))+count(*))/(2*count(*))) as bigint) mean_cents from orders group by o_custkey")
def mean_confidence(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(E.mean_cents(c("o_totalprice")).alias("mean_cents"))


@query("confidence_status", sql="select event_id, case when value>=70 then 'SUCCESS' else 'LOW_CONFIDENCE' end st from events")
def confidence_status(spark, d):
    return table(spark, d, "events").select("event_id", E.confidence_status(c("value")).alias("st"))


@query("confidence_band", sql="select event_id, case when value>=90 then null when value>=70 then 'warning' else 'danger' end band from events")
def confidence_band(spark, d):
    return table(spark, d, "events").select("event_id", E.confidence_band(c("value")).alias("band"))


@query("head_count_check", sql="select o_custkey, case when h=0 then 'NO_HEAD' when h>1 then 'MULTI_HEAD' else 'OK' end st from (select o_custkey, count(case when o_orderpriority='1-URGENT' then 1 end) h from orders group by o_custkey) z")
def head_count_check(spark, d):
    return quality.head_check(table(spark, d, "orders"), "o_custkey", c("o_orderpriority") == "1-URGENT")


@query("distinct_violation", sql="select source, count(*)<>count(distinct text) v from documents group by source")
def distinct_violation(spark, d):
    return table(spark, d, "documents").groupBy("source").agg((F.count(F.lit(1)) != F.count_distinct(F.sha2("text", 256))).alias("v"))


@query("record_quality", sql="select source, count(*) n, count(distinct text) u, count(case when trim(text)='' then 1 end) blank from documents group by source")
def record_quality(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2("text", 256)).alias("u"), F.count_if(F.trim("text") == "").alias("blank"))


@query("snapshot_manifest", sql="select 'orders' tbl, count(*) n, min(o_orderkey) lo, max(o_orderkey) hi, sum(o_orderkey)::bigint sk from orders union all select 'documents', count(*), min(doc_id), max(doc_id), sum(length(text))::bigint from documents")
def manifest(spark, d):
    return snapshot_manifest({"orders": (table(spark, d, "orders"), "o_orderkey", c("o_orderkey")), "documents": (table(spark, d, "documents"), "doc_id", F.length("text"))})


@query("recent_activity", sql="select kind,id,ts from (select * from (select 'kk' kind, o_orderkey id, o_orderdate ts from orders order by o_orderdate desc,o_orderkey desc limit 5) a union all select * from (select 'ev' kind, event_id id, ts from events order by ts desc,event_id desc limit 5) b) z order by ts desc,id desc")
def recent_activity(spark, d):
    return reports.recent_activity([("kk", table(spark, d, "orders"), "o_orderkey", "o_orderdate"), ("ev", table(spark, d, "events"), "event_id", "ts")])


# Latest rows, history, plans


@query("head_of_household", sql="select o_custkey kk, o_orderkey head from (select o.*, row_number() over(partition by o_custkey order by o_orderkey desc) rn from orders o where o_orderpriority='1-URGENT') z where rn=1")
def head_of_household(spark, d):
    return views.head_of_household(table(spark, d, "orders"), "o_custkey", "o_orderkey", c("o_orderpriority") == "1-URGENT").withColumnRenamed("o_custkey", "kk")


@query("active_version", sql="select event_id, user_id, event_type, row_number() over(partition by user_id,event_type order by event_id desc)=1 is_active from events")
def active_version(spark, d):
    return views.active_version(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("first_occurrence_dedupe", sql="select doc_id from (select doc_id, row_number() over(partition by text order by doc_id) rn from documents) z where rn=1")
def first_occurrence_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("membership_scd2", sql="select user_id, event_id, cast(ts as date) effective_date, cast(lead(ts) over(partition by user_id order by ts,event_id) as date) end_date, case when lead(ts) over(partition by user_id order by ts,event_id) is null then 'AKTIF' else 'KELUAR' end status from events")
def membership_scd2(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return membership.history(e, "user_id", ["ts", "event_id"], "ts").drop("ts")


def _incoming(spark, d):
    return table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("nik")).agg(F.min("l_partkey").alias("kk_id"))


def _known(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 100000").select(c("o_orderkey").alias("nik"), c("o_custkey").alias("kk_id"), (c("o_orderstatus") == "O").alias("active"))


_PLAN = "from (select l_orderkey k, min(l_partkey) kk from lineitem group by l_orderkey) i left join orders o on o.o_orderkey=i.k and o.o_totalprice>100000"


@query("upsert_plan", sql=f"select i.k nik, case when o.o_orderkey is null then 'INSERT' when o.o_orderstatus<>'O' then 'REJECT_INACTIVE' when o.o_custkey=i.kk then 'KEEP' else 'MOVE' end as action {_PLAN}")
def upsert_plan(spark, d):
    return membership.upsert_plan(_incoming(spark, d), _known(spark, d), "move_active")


@query("upsert_plan_create", sql=f"select i.k nik, case when o.o_orderkey is null then 'INSERT' else 'MOVE_AND_ACTIVATE' end as action {_PLAN}")
def upsert_plan_create(spark, d):
    return membership.upsert_plan(_incoming(spark, d), _known(spark, d), "force_active")


@query("upsert_plan_reject", sql=f"select i.k nik, case when o.o_orderkey is null then 'INSERT' else 'DUPLICATE' end as action {_PLAN}")
def upsert_plan_reject(spark, d):
    return membership.upsert_plan(_incoming(spark, d), _known(spark, d), "reject")


@query("import_plan", sql="select o_custkey, case when sum(case when o_totalprice<5000 then 1 else 0 end)>0 then 'INVALID' else 'SAVED' end st, count(*) n from orders group by o_custkey")
def import_plan(spark, d):
    return membership.import_plan(table(spark, d, "orders"), "o_custkey", c("o_totalprice") < 5000)


@query("not_yet_imported", sql="select event_id from events where json_extract_string(props,'$.k') is null or cast(json_extract_string(props,'$.k') as int)<50")
def not_yet_imported(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").filter(k.isNull() | (k.cast("int") < 50)).select("event_id")


@query("seed_lookup_antijoin", sql="select v.name from (values ('BUILDING'),('NEW A'),('NEW B')) v(name) where not exists(select 1 from customer c where c.c_mktsegment=v.name)")
def seed_lookup_antijoin(spark, d):
    return views.new_names(spark.createDataFrame([("BUILDING",), ("NEW A",), ("NEW B",)], "name string"), table(spark, d, "customer"), "name", "c_mktsegment")


@query("dimension_growth", sql="select cast(row_number() over (order by name) as bigint) id, case name when 'new a' then 'New A' else 'New/B' end name from (values ('new a'), ('new/b')) v(name) union all select * from (values (cast(0 as bigint), 'BUILDING'))")
def dimension_growth(spark, d):
    known = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.lit(0).cast("long").alias("id"), c("c_mktsegment").alias("name")).distinct()
    return views.grow_dimension(known, spark.createDataFrame([("building ",), ("new a",), (" NEW  A",), ("NEW/b",)], "name string"))


@query("settings_singleton", sql="select d.k, coalesce(r.r_name,d.v) v from (values (1,'DEF1'),(99,'DEF99')) d(k,v) left join region r on r.r_regionkey=d.k")
def settings_singleton(spark, d):
    return views.settings_or_default(spark.createDataFrame([(1, "DEF1"), (99, "DEF99")], "k int, v string"), table(spark, d, "region"), "k", "v", "r_regionkey", "r_name")


@query("backfill_area", sql="select c.c_custkey, coalesce(h.k,m.k) rt from customer c left join (select o_custkey, max(o_orderkey) k from orders where o_orderpriority='1-URGENT' group by o_custkey) h on h.o_custkey=c.c_custkey left join (select o_custkey, min(o_orderkey) k from orders group by o_custkey) m on m.o_custkey=c.c_custkey")
def backfill_area(spark, d):
    return views.backfill_area(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", "o_orderkey", c("o_orderpriority") == "1-URGENT", c("o_orderkey"))


# Sorts and pages


@query("sorted_residents", sql="select c_name,c_custkey from customer order by c_name,c_custkey")
def sorted_residents(spark, d):
    return table(spark, d, "customer").select("c_name", "c_custkey").orderBy("c_name", "c_custkey")


@query("sorted_households", sql="select o_orderkey,o_orderdate from orders order by o_orderdate desc,o_orderkey desc")
def sorted_households(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("sort_by_relation", sql="select o.o_orderkey,n.n_name from orders o join customer c on o.o_custkey=c.c_custkey join nation n on n.n_nationkey=c.c_nationkey order by n.n_name,o.o_orderkey")
def sort_by_relation(spark, d):
    return residents_located(spark, d).filter("n_name is not null").select("o_orderkey", "n_name").orderBy("n_name", "o_orderkey")


@query("sort_by_relation_enum", sql="select o_orderkey, case o_orderstatus when 'O' then 1 when 'P' then 2 when 'F' then 3 end ord from orders order by ord,o_orderkey")
def sort_by_relation_enum(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.ordinal(c("o_orderstatus"), list(STATUS)).alias("ord")).orderBy("ord", "o_orderkey")


@query("offset_page", sql="select c_custkey,c_name from customer order by c_name, c_custkey limit 25 offset 50")
def offset_page(spark, d):
    return filters.offset_page(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 3)


@query("keyset_page", sql="select o_orderkey,o_custkey from orders where o_orderkey>7000 order by o_orderkey limit 500")
def keyset_page(spark, d):
    return filters.keyset_page(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 7000)


@query("natural_sort_key", sql=r"select c_custkey, array_to_string(list_transform(regexp_extract_all(lower(c_name),'(\d+|\D+)',1), lambda x: case when regexp_full_match(x,'\d+') then lpad(x,20,'0') else x end),'') k from customer")
def natural_sort_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", E.natural_sort_key(c("c_name")).alias("k"))


# Lookups of RTs


@query("rt_resolve_lowest_id", sql="select n_nationkey from nation where n_regionkey=2 order by n_nationkey limit 1")
def rt_resolve_lowest_id(spark, d):
    return table(spark, d, "nation").filter("n_regionkey = 2").select("n_nationkey").orderBy("n_nationkey").limit(1)


@query("rt_resolve_variants", sql="select p_partkey from part where cast(p_size as varchar(10)) in ('5','05','005')")
def rt_resolve_variants(spark, d):
    return table(spark, d, "part").filter(c("p_size").cast("string").isin(filters.rt_number_variants("05"))).select("p_partkey")


@query("rt_options", sql="select n_nationkey, concat('RT ',n_name) as label from nation where n_regionkey=2 order by n_name")
def rt_options(spark, d):
    return table(spark, d, "nation").filter("n_regionkey = 2").orderBy("n_name").select("n_nationkey", F.concat(F.lit("RT "), c("n_name")).alias("label"))


@query("point_lookup", sql="select * from customer where c_custkey=42")
def point_lookup(spark, d):
    return table(spark, d, "customer").filter("c_custkey = 42")


# Filters and searches


@query("active_filter", sql="select o_orderkey from orders where o_orderstatus='O'")
def active_filter(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey")


@query("substring_search", sql="select c_custkey from customer where c_name ilike '%ER#00000014%'")
def substring_search(spark, d):
    return table(spark, d, "customer").filter(E.contains_any([c("c_name")], "er#00000014")).select("c_custkey")


@query("resident_search", sql="select o.o_orderkey from orders o left join customer c on c.c_custkey=o.o_custkey left join nation n on n.n_nationkey=c.c_nationkey left join region r on r.r_regionkey=n.n_regionkey where cast(o.o_orderkey as varchar(20)) ilike '%asia%' or c.c_name ilike '%asia%' or n.n_name ilike '%asia%' or r.r_name ilike '%asia%'")
def resident_search(spark, d):
    # From the small tables up: matching RTs, the households that match or lie in one, then the residents. Only keys meet the large table.
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rts = n.join(r, c("n_regionkey") == c("r_regionkey"), "left").filter(E.contains_any([c("n_name"), c("r_name")], "asia"))
    homes = filters.flag_with(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), rts, "c_nationkey", "n_nationkey", "f").filter(E.contains_any([c("c_name")], "asia") | c("f"))
    people = filters.flag_with(table(spark, d, "orders").select("o_orderkey", "o_custkey"), homes, "o_custkey", "c_custkey", "f")
    return people.filter(E.contains_any([c("o_orderkey")], "asia") | c("f")).select("o_orderkey")


@query("resident_search_export", sql="select o.o_orderkey from orders o where cast(o.o_orderkey as varchar(20)) ilike '%77%' or exists(select 1 from customer c where c.c_custkey=o.o_custkey and c.c_name ilike '%77%')")
def resident_search_export(spark, d):
    matched = table(spark, d, "customer").filter(E.contains_any([c("c_name")], "77"))
    flagged = filters.flag_with(table(spark, d, "orders").select("o_orderkey", "o_custkey"), matched, "o_custkey", "c_custkey", "f")
    return flagged.filter(E.contains_any([c("o_orderkey")], "77") | c("f")).select("o_orderkey")


@query("household_search", sql="select c_custkey from customer c where c_name ilike '%00014%' or exists(select 1 from orders o where o.o_custkey=c.c_custkey and o.o_orderpriority='1-URGENT' and cast(o.o_orderkey as varchar(20)) like '%00014%')")
def household_search(spark, d):
    heads = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return filters.household_search(table(spark, d, "customer"), heads, "00014", ["c_name"], "c_custkey", "o_custkey", ["o_orderkey"]).select("c_custkey")


@query("multi_filter_and", sql="select o.o_orderkey from orders o where o_orderstatus='O' and o_orderpriority='2-HIGH' and cast(o_orderdate as date)<=date '2010-03-01' - interval 10 year and exists(select 1 from customer c join nation n on n.n_nationkey=c.c_nationkey where c.c_custkey=o.o_custkey and n.n_regionkey=2)")
def multi_filter_and(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey = 2")
    homes = filters.keep_with(table(spark, d, "customer"), n, "c_nationkey", "n_nationkey")
    view = born(table(spark, d, "orders")).withColumnsRenamed({"o_orderstatus": "resident_status"})
    out = filters.apply_filters(view, filters.FilterSpec(resident_status="O", age_min=10), AS_OF).filter("o_orderpriority = '2-HIGH'")
    return filters.keep_with(out, homes, "o_custkey", "c_custkey").select("o_orderkey")


@query("age_range_filter", sql="select o_orderkey from orders where cast(o_orderdate as date) <= date '2010-03-01' - interval 13 year and cast(o_orderdate as date) > date '2010-03-01' - interval 18 year")
def age_range_filter(spark, d):
    return filters.apply_filters(born(table(spark, d, "orders")), filters.FilterSpec(age_min=13, age_max=17), AS_OF).select("o_orderkey")


@query("exact_age_filter", sql="select o_orderkey from orders where cast(o_orderdate as date) <= date '2010-03-01' - interval 12 year and cast(o_orderdate as date) > date '2010-03-01' - interval 13 year")
def exact_age_filter(spark, d):
    return filters.apply_filters(born(table(spark, d, "orders")), filters.FilterSpec(age=12), AS_OF).select("o_orderkey")


@query("age_column", sql="select o_orderkey, cast((year(date '2010-03-01')-year(o_orderdate)-case when month(o_orderdate)*100+day(o_orderdate) > 301 then 1 else 0 end) as int) age from orders")
def age_column(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.age_years(c("o_orderdate"), AS_OF).alias("age"))


@query("age_preset_bucket", sql="select case when a between 0 and 5 then 'balita' when a between 6 and 12 then 'anak' when a between 13 and 17 then 'remaja' when a between 18 and 59 then 'dewasa' when a>=60 then 'lansia' end preset, count(*) n from (select (year(date '2010-03-01')-year(o_orderdate)-case when month(o_orderdate)*100+day(o_orderdate) > 301 then 1 else 0 end) a from orders) z group by 1")
def age_preset_bucket(spark, d):
    return table(spark, d, "orders").groupBy(E.age_preset(E.age_years(c("o_orderdate"), AS_OF)).alias("preset")).agg(F.count(F.lit(1)).alias("n"))


@query("null_scopes", sql="select count(case when l.quality is null then 1 end) without_q, count(case when l.quality is not null then 1 end) with_q from documents d left join labels l on l.doc_id=d.doc_id")
def null_scopes(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.agg(F.count_if(c("quality").isNull()).alias("without_q"), F.count_if(c("quality").isNotNull()).alias("with_q"))


@query("in_list", sql="select c_custkey from customer where c_custkey in (1,5,9,99999)")
def in_list(spark, d):
    return table(spark, d, "customer").filter(c("c_custkey").isin(1, 5, 9, 99999)).select("c_custkey")


@query("unique_check_excluding_self", sql="select count(*) n from documents d where d.text=(select text from documents where doc_id=5) and d.doc_id<>5")
def unique_check_excluding_self(spark, d):
    return quality.same_value_elsewhere(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id", 5)


@query("semi_join", sql="select c_custkey from customer c where exists(select 1 from orders o where o.o_custkey=c.c_custkey and o.o_totalprice>480000)")
def semi_join(spark, d):
    return filters.keep_with(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_totalprice > 480000"), "c_custkey", "o_custkey")


@query("nested_semi_join", sql="select c_custkey from customer c where exists(select 1 from nation n join region r on n.n_regionkey=r.r_regionkey where n.n_nationkey=c.c_nationkey and r.r_regionkey=2)")
def nested_semi_join(spark, d):
    n = filters.keep_with(table(spark, d, "nation"), table(spark, d, "region").filter("r_regionkey = 2"), "n_regionkey", "r_regionkey")
    return filters.keep_with(table(spark, d, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", "n_nationkey").select("c_custkey")


@query("historical_households", sql="select c_custkey from customer c where not exists(select 1 from orders o where o.o_custkey=c.c_custkey and o.o_totalprice>400000) and exists(select 1 from orders o where o.o_custkey=c.c_custkey and o.o_totalprice<100000)")
def historical_households(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    return filters.historical_households(table(spark, d, "customer").select("c_custkey"), o.filter("o_totalprice > 400000"), o.filter("o_totalprice < 100000"), "c_custkey", "o_custkey")


@query("active_households", sql="select c_custkey from customer c where exists(select 1 from orders o where o.o_custkey=c.c_custkey and o.o_orderstatus='O' and o.o_totalprice>450000) or not exists(select 1 from orders o where o.o_custkey=c.c_custkey and o.o_totalprice>490000)")
def active_households(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    return filters.active_households(table(spark, d, "customer").select("c_custkey"), o.filter("o_orderstatus = 'O' and o_totalprice > 450000"), o.filter("o_totalprice > 490000"), "c_custkey", "o_custkey")


# Labels, projections, joins


@query("enum_labels", sql="select o_orderkey, case o_orderstatus when 'O' then 'Aktif' when 'P' then 'Pindah' when 'F' then 'Meninggal' else '-' end lbl from orders")
def enum_labels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.label(c("o_orderstatus"), STATUS).alias("lbl"))


@query("export_projection", sql="select lpad(cast(o_orderkey as varchar(20)),16,'0') nik, c_name, case o_orderstatus when 'O' then 'Aktif' when 'P' then 'Pindah' when 'F' then 'Meninggal' else '-' end status, coalesce(n_name,'-') rt, coalesce(r_name,'-') rw, strftime(o_orderdate,'%d-%m-%Y') tgl from orders o left join customer c on o.o_custkey=c.c_custkey left join nation n on n.n_nationkey=c.c_nationkey left join region r on r.r_regionkey=n.n_regionkey")
def export_projection(spark, d):
    return residents_located(spark, d).select(
        E.pad_left(c("o_orderkey").cast("string"), 16).alias("nik"), "c_name", E.label(c("o_orderstatus"), STATUS).alias("status"), F.coalesce("n_name", F.lit("-")).alias("rt"),
        F.coalesce("r_name", F.lit("-")).alias("rw"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("tgl"),
    )


@query("export_csv", sql=ORACLES["export_projection"])
def export_csv(spark, d):
    """Through the CSV sink and back."""
    rows, path = export_projection(spark, d), fresh_dir(spark, "csv")
    write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("file_inventory")
def inventory(spark, d):
    return file_inventory(spark, d).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "size", "sha256", "mime_type")


@query("rt_rw_label", sql="select n_nationkey, concat_ws(' / ', r_name, concat('RT ',n_name)) l from nation n left join region r on r.r_regionkey=n.n_regionkey and r.r_regionkey<3")
def rt_rw_label(spark, d):
    r = table(spark, d, "region").filter("r_regionkey < 3")
    return table(spark, d, "nation").join(r, c("n_regionkey") == r["r_regionkey"], "left").select("n_nationkey", E.rt_rw_label(c("r_name"), c("n_name")).alias("l"))


@query("area_display_label", sql="select r_regionkey, case when r_regionkey % 2 = 0 then 'RW ' || case when r_regionkey > 1 then cast(r_regionkey as varchar) else r_name end else r_name end l from region")
def area_display_label(spark, d):
    kind, code = F.when(c("r_regionkey") % 2 == 0, "rw").otherwise("lingkungan"), F.when(c("r_regionkey") > 1, c("r_regionkey").cast("string"))
    return table(spark, d, "region").select("r_regionkey", E.area_label(kind, code, c("r_name")).alias("l"))


@query("resident_area_label", sql="select o_orderkey, coalesce(r_name,'-') a from orders o left join customer c on c.c_custkey=o.o_custkey left join nation n on n.n_nationkey=c.c_nationkey left join region r on r.r_regionkey=n.n_regionkey")
def resident_area_label(spark, d):
    return residents_located(spark, d).select("o_orderkey", F.coalesce("r_name", F.lit("-")).alias("a"))


@query("household_nested", sql="select o_custkey, string_agg(cast(o_orderkey as varchar),',' order by o_orderkey) members, count(*) n from orders group by o_custkey")
def household_nested(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    out = views.nested(o.select("o_custkey").distinct(), o.withColumnRenamed("o_custkey", "k"), "o_custkey", "k", ["o_orderkey"])
    return out.select("o_custkey", F.array_join(F.transform("members", lambda x: x["o_orderkey"].cast("string")), ",").alias("members"), F.size("members").cast("long").alias("n"))


@query("resident_detail_json", sql="select o_orderkey, cast(to_json({'nik':lpad(cast(o_orderkey as varchar),16,'0'),'status':o_orderstatus}) as varchar) j from orders")
def resident_detail_json(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(E.pad_left(c("o_orderkey").cast("string"), 16).alias("nik"), c("o_orderstatus").alias("status"))).alias("j"))


@query("morph_join", sql="select e.event_id, c.c_name from events e join customer c on e.event_type='signup' and e.user_id=c.c_custkey")
def morph_join(spark, d):
    return views.morph_join(table(spark, d, "events"), table(spark, d, "customer").select("c_custkey", "c_name"), "signup", "event_type", "user_id", "c_custkey").select("event_id", "c_name")


@query("nik_conflicts", sql="select a, doc_id b from (select doc_id, min(doc_id) over (partition by text) a from documents where text is not null) z where a < doc_id")
def nik_conflicts(spark, d):
    return views.conflicts(table(spark, d, "documents"), c("text"), "doc_id")


@query("normalized_lookup_join", sql="select c.c_custkey, v.id from customer c join (values (1,' Building '),(2,'FURNITURE')) v(id,name) on lower(trim(c.c_mktsegment))=lower(trim(v.name))")
def normalized_lookup_join(spark, d):
    names = spark.createDataFrame([(1, " Building "), (2, "FURNITURE")], "id int, name string")
    return views.lookup_ids(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), names, c("c_mktsegment")).select("c_custkey", "id")


@query("apply_corrections", sql="select d.doc_id, coalesce(b.text,d.text) text from documents d left join benchmark b on b.item_id=d.doc_id")
def apply_corrections(spark, d):
    return views.corrected(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"), "doc_id", "item_id", {"text": "text"})


@query("archive_validate", sql="select page_id, url not like '/%' and instr(url,'\\')=0 and instr(url,'..')=0 and length(html)<=5000 ok from pages")
def archive_validate(spark, d):
    inventory = table(spark, d, "pages").select("page_id", c("url").alias("name"), F.length("html").alias("size"))
    return inventory.select("page_id", (F.size(archive_errors(c("name"), c("size"), 5000)) == 0).alias("ok"))


# Text fields


@query("ocr_line_assembly", sql="select conv_id, string_agg(role,' ' order by turn) line, count(*) words from conversations group by conv_id")
def ocr_line_assembly(spark, d):
    lines = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("w"))
    return lines.select("conv_id", F.array_join(c("w.role"), " ").alias("line"), F.size("w").cast("long").alias("words"))


@query("normalize_lines", sql=r"select doc_id, len(list_filter(list_transform(string_split(replace(replace(replace(replace(text,chr(160),' '),chr(8203),''),chr(13)||chr(10),chr(10)),chr(13),chr(10)),chr(10)), lambda x: trim(regexp_replace(x,'[ \t]+',' ','g'))), lambda x: x<>'')) n from documents")
def normalize_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(E.normalize_lines(c("text"))).cast("long").alias("n"))


@query("tokenize", sql=r"select doc_id, len(list_filter(regexp_split_to_array(trim(text),'\s+'), lambda x: x <> '')) n from documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(E.tokens(c("text"))).cast("long").alias("n"))


@query("header_kv", sql="select page_id, regexp_extract(lower(html),'<title>([^<]*)',1) v, regexp_extract(url,'page=([0-9]+)',1) pg from pages")
def header_kv(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract(F.lower("html"), "<title>([^<]*)", 1).alias("v"), F.regexp_extract("url", "page=([0-9]+)", 1).alias("pg"))


@query("extract_id16", sql=r"select doc_id, regexp_extract(regexp_replace(text,'[\s.\-/]+','','g'),'(?:^|[^0-9])([0-9]{16})(?:[^0-9]|$)',1) k from documents")
def extract_id16(spark, d):
    return table(spark, d, "documents").select("doc_id", E.id16(c("text"), repair=False).alias("k"))


@query("rt_rw_pair", sql=r"select doc_id, regexp_extract(text,'(\d{1,3})\s*[-/]\s*(\d{1,3})',1) a, regexp_extract(text,'(\d{1,3})\s*[-/]\s*(\d{1,3})',2) b from documents")
def rt_rw_pair(spark, d):
    a, b = E.rt_rw_pair(c("text"))
    return table(spark, d, "documents").select("doc_id", a.alias("a"), b.alias("b"))


@query("area_number", sql="select p_partkey, case when p_size<10 then lpad(cast(p_size as varchar(5)),2,'0') else cast(p_size as varchar(5)) end n from part")
def area_number(spark, d):
    return table(spark, d, "part").select("p_partkey", E.area_number(c("p_size").cast("string")).alias("n"))


@query("parse_date", sql=r"select o_orderkey, cast(try_strptime(lpad(cast(1 + o_orderkey % 32 as varchar), 2, '0') || '-' || lpad(cast(1 + o_orderkey % 13 as varchar), 2, '0') || '-' || cast(1890 + o_orderkey % 150 as varchar), '%d-%m-%Y') as date) k from orders where 1890 + o_orderkey % 150 >= 1900 union all select o_orderkey, null from orders where 1890 + o_orderkey % 150 < 1900")
def parse_date(spark, d):
    text = F.concat(F.lit("x "), (1 + c("o_orderkey") % 32).cast("string"), F.lit("-"), (1 + c("o_orderkey") % 13).cast("string"), F.lit("/"), (1890 + c("o_orderkey") % 150).cast("string"), F.lit(" y"))
    return table(spark, d, "orders").select("o_orderkey", E.parse_date(text).alias("k"))


@query("canonical_enum", sql="select o_orderkey, case upper(trim(o_orderpriority)) when '1-URGENT' then 'KEPALA_KELUARGA' when '2-HIGH' then 'ISTRI' when '3-MEDIUM' then 'ANAK' else null end e from orders")
def canonical_enum(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.canonical_enum(c("o_orderpriority"), {"1-URGENT": "KEPALA_KELUARGA", "2-HIGH": "ISTRI", "3-MEDIUM": "ANAK"}).alias("e"))


@query("digits_only", sql="select c_custkey, regexp_replace(c_name,'[^0-9]','','g') dg from customer")
def digits_only(spark, d):
    return table(spark, d, "customer").select("c_custkey", E.digits_only(c("c_name")).alias("dg"))


@query("filter_slug", sql="select o_orderkey, concat_ws('_',concat('jk-',lower(regexp_replace(o_orderpriority,'[^A-Za-z0-9]+','-','g'))),concat('status-',lower(o_orderstatus))) s from orders")
def filter_slug(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("_", F.concat(F.lit("jk-"), E.slug(c("o_orderpriority"))), F.concat(F.lit("status-"), E.slug(c("o_orderstatus")))).alias("s"))


@query("format_count", sql="select o_orderkey, replace(format('{:,}', o_orderkey * 1000), ',', '.') || ' jiwa' s from orders")
def format_count(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.format_count(c("o_orderkey") * 1000, " jiwa").alias("s"))


@query("content_hash", sql="select doc_id, sha256(text) h from documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("mime_sniff", sql="select page_id, case when page_id % 3 = 0 then 'application/pdf' when page_id % 3 = 1 then 'image/jpeg' end m from pages")
def mime_sniff(spark, d):
    head = F.when(c("page_id") % 3 == 0, F.unhex(F.lit("255044462D"))).when(c("page_id") % 3 == 1, F.unhex(F.lit("FFD8FF"))).otherwise(F.encode(F.lit("<htm"), "UTF-8"))
    return table(spark, d, "pages").select("page_id", E.mime_type(F.concat(head, F.encode("html", "UTF-8"))).alias("m"))


def household_texts(spark: SparkSession, d: str) -> DataFrame:
    """A scanned card per customer, its orders the members."""
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (c(key) % len(values) + 1).cast("int"))
    nik = E.pad_left(c("o_orderkey").cast("string"), 16)
    spread = F.concat_ws(" ", *[F.substring(nik, i, 4) for i in (1, 5, 9, 13)])
    row = F.concat_ws(
        " ", F.lit("1 NAMA"), F.concat(F.lit("X"), c("o_orderkey").cast("string")), F.when(c("o_orderkey") % 3 == 0, spread).otherwise(nik), pick(["LAKI-LAKI", "PEREMPUAN", "LAKI LAKI"], "o_orderkey"), F.lit("KOTA TUA"),
        F.date_format("o_orderdate", "dd-MM-yyyy"), pick(["ISLAM", "KAT0LIK", "H1NDU"], "o_orderkey"), pick(["SD", "DIPLOMA I/II", "BELUM TAMAT SD/SEDERAJAT"], "o_orderkey"),
        pick(["PETANI", "BURUH", "BURUH HARIAN LEPAS", "IBU RUMAH TANGGA"], "o_orderkey"), pick(["KAWIN", "BELUM KAW1N"], "o_orderkey"), pick(["ISTRI", "KEPALA KELUARGA", "AN4K"], "o_orderkey"),
    )
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("m"))
    top = F.concat(F.lit("NOMOR KK : "), E.pad_left(c("o_custkey").cast("string"), 16), F.lit("\nALAMAT : Jl. "), c("o_custkey").cast("string"), F.lit("\nRT/RW : 0"), (1 + c("o_custkey") % 9).cast("string"), F.lit("/"), (1 + c("o_custkey") % 90).cast("string"), F.lit("\nNO NAMA NIK\n"))
    return lists.select(c("o_custkey").alias("id"), F.concat(top, F.array_join(F.col("m.row"), "\n")).alias("raw_text"), F.lit(90.0).alias("confidence"))


@query("parse_header", sql="select distinct o_custkey id, lpad(cast(o_custkey as varchar), 16, '0') kk_number, 'JL. ' || o_custkey address, lpad(cast(1 + o_custkey % 9 as varchar), 2, '0') rt, case when 1 + o_custkey % 90 < 10 then '0' else '' end || (1 + o_custkey % 90) rw from orders")
def parse_header(spark, d):
    return parse_households(household_texts(spark, d), 2100).select("id", "kk_number", "address", "rt", "rw")


_NTH = "list_extract([{}], cast(o_orderkey % {} + 1 as int))"


@query(
    "parse_members",
    sql="select o_custkey id, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) ordinal, 'NAMA X' || o_orderkey nama, lpad(cast(o_orderkey as varchar), 16, '0') nik, "
    + _NTH.format("'LAKI_LAKI','PEREMPUAN','LAKI_LAKI'", 3) + " gender, 'KOTA TUA' birth_place, strftime(o_orderdate, '%Y-%m-%d') birth_date, " + _NTH.format("'ISLAM','KATOLIK','HINDU'", 3) + " religion, "
    + _NTH.format("'SD','DIPLOMA I/II','BELUM TAMAT SD/SEDERAJAT'", 3) + " education, " + _NTH.format("'PETANI','BURUH','BURUH HARIAN LEPAS','IBU RUMAH TANGGA'", 4) + " occupation, "
    + _NTH.format("'KAWIN','BELUM_KAWIN'", 2) + " marital_status, " + _NTH.format("'ISTRI','KEPALA_KELUARGA','ANAK'", 3) + " family_relation from orders",
)
def parse_members(spark, d):
    # Aliases are values only where phrases match; the text of a phrase is its canonical spelling.
    rows = parse_households(household_texts(spark, d), 2100).select("id", F.posexplode("members").alias("i", "m"))
    return rows.select("id", (c("i") + 1).alias("ordinal"), "m.nama", "m.nik", "m.gender", "m.birth_place", "m.birth_date", "m.religion", "m.education", "m.occupation", "m.marital_status", "m.family_relation")


from hearthspark.plans import cards, files, kept, more, overlay, sqlfunctions, versions  # noqa: E402, F401  register further queries
