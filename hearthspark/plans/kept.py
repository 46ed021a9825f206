"""Queries on counts that are kept up to date, and on job states from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthspark.operators import counters
from hearthspark.plans.catalog import query
from hearthspark.sources.cuts import fresh_dir
from hearthspark.sources.tables import table
from hearthspark.streaming import jobs

c = F.col

_KEPT = """
with changed as (
  select o_custkey, o_orderpriority, o_orderdate, case when o_totalprice > 250000 and o_orderstatus = 'O' then 'P' when o_totalprice < 50000 then null else o_orderstatus end o_orderstatus
  from orders where not (o_orderstatus = 'F' and o_totalprice > 400000)
  union all select o_custkey, '1-URGENT', o_orderdate, 'O' from orders where o_orderpriority = '5-LOW' and o_totalprice > 300000)
select 'status' dimension, o_orderstatus as value, count(*) n from changed group by 2
union all select 'priority', o_orderpriority, count(*) from changed group by 2
union all select 'year', cast(year(o_orderdate) as varchar), count(*) from changed group by 2
union all select 'household', cast(o_custkey as varchar), count(*) from changed group by 2
"""


@query("counts_kept", sql=_KEPT)
def counts_kept(spark, d):
    """Counts by status, priority, year and household after three batches of changes, one of which comes twice."""
    cols = ["o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus"]
    rows, root = table(spark, d, "orders"), fresh_dir(spark, "counts")
    dimensions = {"status": "o_orderstatus", "priority": "o_orderpriority", "year": "year(o_orderdate)", "household": "o_custkey"}
    counters.create(rows, dimensions, root)
    row, status = F.struct(*cols), lambda to: F.struct(*cols[:3], to.cast("string").alias("o_orderstatus"))
    gone = (c("o_orderstatus") == "F") & (c("o_totalprice") > 400_000)
    moved = F.when(c("o_totalprice") < 50_000, F.lit(None)).otherwise(F.lit("P"))
    batches = {
        "moved": rows.filter(((c("o_totalprice") > 250_000) & (c("o_orderstatus") == "O")) | (c("o_totalprice") < 50_000)).select(row.alias("before"), status(moved).alias("after")),
        "deleted": rows.filter(gone).select(row.alias("before"), F.when(F.lit(False), row).alias("after")),
        "born": rows.filter((c("o_orderpriority") == "5-LOW") & (c("o_totalprice") > 300_000)).select(F.when(F.lit(False), row).alias("before"), F.struct("o_custkey", F.lit("1-URGENT").alias("o_orderpriority"), "o_orderdate", F.lit("O").alias("o_orderstatus")).alias("after")),
    }
    for name in ("moved", "deleted", "born", "deleted"):
        counters.update(spark, root, name, batches[name], dimensions)
    return counters.counts(spark, root)


_JOBS = """
with recursive e as (
  select user_id, epoch_us(ts) // 1000 ms, event_id, value,
    case event_type when 'signup' then 'queued' when 'click' then 'started' when 'error' then 'failed' else 'done' end kind from events where user_id is not null),
w as (select max(ms) - 3600000 w from e),
n as (select user_id, ms, kind, value, row_number() over (partition by user_id order by ms, event_id) i from e, w where ms < w),
s as (
  select user_id, cast(0 as bigint) i, cast(null as varchar) status, cast(null as bigint) due, cast(null as bigint) late, cast(null as varchar) new, cast(null as bigint) ms, cast(null as varchar) kind from (select distinct user_id from n)
  union all
  select user_id, i, case when new is not null then case when new in ('PENDING','PROCESSING') then new end else st end,
    case when new is not null then case when new in ('PENDING','PROCESSING') then ms + 43200000 end when late is null then due end, late, coalesce(new, 'REFUSED'), ms, kind
  from (select *, case when kind = 'queued' and st is null then 'PENDING' when kind = 'started' and st = 'PENDING' then 'PROCESSING' when kind = 'failed' and st is not null then 'FAILED'
      when kind = 'done' and st = 'PROCESSING' then case when value >= 70 then 'SUCCESS' else 'LOW_CONFIDENCE' end end new
    from (select n.user_id, n.i, n.ms, n.kind, n.value, s.due, case when s.due < n.ms then s.due end late, case when s.due < n.ms then null else s.status end st from s join n on n.user_id = s.user_id and n.i = s.i + 1) a) b)
select user_id job_id, late as at_ms, 'FAILED' status, 'timeout' note from s where late is not null
union all select user_id, ms, new, kind from s where i > 0
union all select user_id, due, 'FAILED', 'timeout' from (select *, max(i) over (partition by user_id) last from s) z, w where i = last and due < w
"""


@query("job_states", sql=_JOBS)
def job_states(spark, d):
    """Moves of recognition jobs, one for each user, replayed as a stream up to the watermark."""
    kind = F.when(c("event_type") == "signup", "queued").when(c("event_type") == "click", "started").when(c("event_type") == "error", "failed").otherwise("done")
    rows = table(spark, d, "events").select(c("user_id").alias("job_id"), c("ts").cast("timestamp").alias("at"), c("event_id").alias("seq"), kind.alias("kind"), c("value").alias("confidence"))
    root = fresh_dir(spark, "jobs")
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(jobs.EVENT).parquet(f"{root}/in")
    jobs.run_job_moves(stream, f"{root}/out", f"{root}/checkpoint", timeout_minutes=720).awaitTermination()
    return spark.read.schema(jobs.MOVE).parquet(f"{root}/out").select("job_id", F.unix_millis("at").alias("at_ms"), "status", "note")
