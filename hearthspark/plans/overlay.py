"""Queries on corrections at any path of nested households."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthspark.operators import paths
from hearthspark.plans.catalog import query
from hearthspark.sources.tables import table

c = F.col

HOUSEHOLD = {"kk_number": None, "address": {"street": None, "nation": None}, "members": [{"nama": None, "birth": {"place": None, "year": None}}]}

_SQL = """
with h as (
  select o_custkey id, json_object('kk_number', cast(o_custkey as varchar), 'address', json_object('street', 'JL. ' || o_custkey, 'nation', o_custkey % 25), 'members',
    to_json(list(json_object('nama', 'N' || o_orderkey, 'birth', json_object('place', o_orderpriority, 'year', year(o_orderdate))) order by o_orderkey))) j from orders group by o_custkey),
k as (
  select user_id id, event_id seen, case event_type when 'view' then 'members.' || event_id % 3 || '.nama' when 'click' then 'members.' || event_id % 3 || '.birth' when 'error' then 'address' else 'members.x.nama' end p,
    case event_type when 'view' then to_json('E' || event_id) when 'click' then json_object('place', 'P' || event_id, 'hour', event_id % 24) when 'error' then json_object('street', null, 'nation', json_object('code', event_id)) else to_json(event_id) end v from events),
f as (
  select id, seen, p path, v, 0 lvl from k where json_type(v) <> 'OBJECT'
  union all select id, seen, p || '.' || x.key, json_extract(v, '$.' || x.key), 1 from k, unnest(json_keys(v)) x(key) where json_type(v) = 'OBJECT' and json_type(json_extract(v, '$.' || x.key)) <> 'OBJECT'
  union all select id, seen, p || '.nation.code', json_extract(v, '$.nation.code'), 2 from k where json_type(json_extract(v, '$.nation')) = 'OBJECT'),
r as (select *, case when path like 'members.x.%' then 2 when path like '%.hour' then 4 when path like 'address.nation.code' then 3 end level from f),
b as (
  select id, 'kk_number' path, json_extract(j, '$.kk_number') v from h
  union all select id, 'address.street', json_extract(j, '$.address.street') from h
  union all select id, 'address.nation', json_extract(j, '$.address.nation') from h
  union all select id, 'members.' || i || '.' || replace(q, '/', '.'), json_extract(j, '/members/' || i || '/' || q) from (select id, j, unnest(range(cast(json_array_length(j, '$.members') as bigint))) i from h) z, (values ('nama'), ('birth/place'), ('birth/year')) t(q))
"""


def _parts(spark, d):
    member = F.struct(F.concat(F.lit("N"), c("o_orderkey")).alias("nama"), F.struct(c("o_orderpriority").alias("place"), F.year("o_orderdate").alias("year")).alias("birth"))
    lists = table(spark, d, "orders").groupBy(c("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", member.alias("m")))).alias("l"))
    home = F.struct(c("id").cast("string").alias("kk_number"), F.struct(F.concat(F.lit("JL. "), c("id")).alias("street"), (c("id") % 25).alias("nation")).alias("address"), F.transform("l", lambda x: x["m"]).alias("members"))
    homes = lists.select("id", F.to_variant_object(home).alias("value"))
    i, kind, e = (c("event_id") % 3).cast("string"), c("event_type"), c("event_id")
    path = F.when(kind == "view", F.concat(F.lit("members."), i, F.lit(".nama"))).when(kind == "click", F.concat(F.lit("members."), i, F.lit(".birth"))).when(kind == "error", "address").otherwise("members.x.nama")
    value = F.when(kind == "view", F.concat(F.lit('"E'), e, F.lit('"'))).when(kind == "click", F.concat(F.lit('{"place":"P'), e, F.lit('","hour":'), e % 24, F.lit("}")))
    value = value.when(kind == "error", F.concat(F.lit('{"street":null,"nation":{"code":'), e, F.lit("}}"))).otherwise(e.cast("string"))
    return homes, table(spark, d, "events").select(c("user_id").alias("id"), path.alias("path"), value.alias("value"), e.alias("at"))


@query("overlay_paths", sql=_SQL + "select coalesce(b.id, n.id) id, coalesce(b.path, n.path) path, cast(case when n.path is not null then n.v else b.v end as varchar) as value from b full join (select id, path, arg_max(v, seen) v from r where level is null group by id, path) n on n.id = b.id and n.path = b.path")
def overlay_paths(spark, d):
    """Leaves of all households with corrections of fields, of members' nested objects and of the address."""
    homes, fixes = _parts(spark, d)
    return paths.overlay(homes, fixes, HOUSEHOLD)


@query("overlay_refused", sql=_SQL + "select path, level, count(*) n, max(seen) last_at from r where level is not null group by path, level")
def overlay_refused(spark, d):
    """What corrections named that no household has, with the level that refused it."""
    found = paths.taken_apart(_parts(spark, d)[1], HOUSEHOLD).filter("level is not null")
    return found.groupBy("path", "level").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))
