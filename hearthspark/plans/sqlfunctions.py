"""Queries in SQL through the registry's SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthspark.functions import sql
from hearthspark.plans import catalog
from hearthspark.plans.catalog import query
from hearthspark.sources.tables import table

c = F.col


@query("sql_card_members", sql=catalog.ORACLES["parse_members"])
def sql_card_members(spark, d):
    """All members of all customers' cards, from the table function."""
    sql.register_cards(spark, catalog.household_texts(spark, d))
    return spark.sql("select m.card as id, m.* except (card) from card_members() m join {customer} on c_custkey = card", customer=table(spark, d, "customer"))


@query("sql_labels", sql="select o_orderkey id, a age, case when a<=5 then 'balita' when a<=12 then 'anak' when a<=17 then 'remaja' when a<=59 then 'dewasa' else 'lansia' end preset, case o_orderstatus when 'O' then 'Aktif' when 'P' then 'Pindah' else '-' end status, 'RW '||o_orderkey%9||' / RT '||o_custkey area from (select *, cast(date_diff('year', o_orderdate, date '2010-03-01') - (strftime(o_orderdate,'%m%d')>'0301')::int as int) a from orders) z")
def sql_labels(spark, d):
    sql.register(spark)
    return spark.sql(
        "select o_orderkey as id, age, registry_age_preset(age) as preset, registry_status(case o_orderstatus when 'O' then 'ACTIVE' when 'P' then 'PINDAH' end) as status, "
        "registry_rt_label(concat('RW ', o_orderkey % 9), cast(o_custkey as string)) as area from (select *, registry_age(cast(o_orderdate as date), date'2010-03-01') as age from {orders})",
        orders=table(spark, d, "orders"),
    )


@query("sql_residents_aged", sql="select o_orderkey id, cast(o_orderdate as date) birth_date from orders where o_orderdate <= date '1997-03-01' and o_orderdate > date '1992-03-01' and cast(o_orderdate as date) <= date '1997-03-01'")
def sql_residents_aged(spark, d):
    """Residents of 13 to 17 years on a day."""
    sql.register_residents(spark, table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_orderdate").cast("date").alias("birth_date")))
    return spark.sql("select * from residents_aged(13, 17, date'2010-03-01')")
