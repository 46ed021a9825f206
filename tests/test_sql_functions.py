"""SQL functions against the column helpers, and their plans."""

from datetime import date

from pyspark.sql import functions as F

from hearthspark.functions import expr as E
from hearthspark.functions import sql
from hearthspark.schemas import FAMILY_RELATION, GENDER, MARITAL_STATUS, RESIDENT_STATUS


def test_scalars_equal_column_helpers(spark):
    sql.register(spark)
    days = [date(1996, 2, 29), date(2000, 3, 1), date(1950, 12, 31), None]
    codes = [*GENDER, *RESIDENT_STATUS, *MARITAL_STATUS, *FAMILY_RELATION, "other", None]
    rows = [(days[i % 4], codes[i % len(codes)], [0, 999, -1234567, 10**12, None][i % 5], ["RT 05/x!", "", None, "--a  B1"][i % 4], [69.9, 70.0, None][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "born date, code string, n bigint, t string, v double")
    c, on = F.col, F.lit(date(2009, 2, 28))
    pairs = [
        (E.age_years(c("born"), on), "registry_age(born, date'2009-02-28')"),
        (E.age_preset(E.age_years(c("born"), on)), "registry_age_preset(registry_age(born, date'2009-02-28'))"),
        *[(E.label(c("code"), x), f"registry_{name}(code)") for name, x in (("gender", GENDER), ("status", RESIDENT_STATUS), ("marital_status", MARITAL_STATUS), ("relation", FAMILY_RELATION))],
        (E.format_count(c("n")), "registry_count(n)"), (E.digits_only(c("t")), "registry_digits(t)"), (E.slug(c("t")), "registry_slug(t)"),
        (E.rt_rw_label(c("t"), c("code")), "registry_rt_label(t, code)"), (E.confidence_status(c("v")), "registry_confidence(v, 70)"),
    ]
    assert df.select(F.sum(F.when(F.lit(False), 0)), *[F.sum((~a.eqNullSafe(F.expr(b))).cast("int")).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first()[1:] == (0,) * len(pairs)


def test_cards_in_sql_without_python(spark):
    card = "NOMOR KK : 3201010101010001\nALAMAT : JL. MAWAR\nRT/RW : 01/02\nNO NAMA NIK\n1 NAMA SITI 3201010101010002 PEREMPUAN KOTA TUA 01-02-1990 ISLAM SD PETANI KAWIN ISTRI"
    sql.register_cards(spark, spark.createDataFrame([(1, card, 90.0), (2, "", 90.0), (3, None, 10.0)], "id bigint, raw_text string, confidence double"))
    out = spark.sql("select t.id, m.* from values (1L), (1L), (2L), (3L), (4L) t(id), card_members() m where m.card = t.id")
    assert [(r["id"], r["nik"], r["gender"]) for r in out.collect()] == [(1, "3201010101010002", "PEREMPUAN")] * 2
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("select kk_number from card_headers() where card = 1").first()["kk_number"] == "3201010101010001"


def test_ages_are_open_without_ends(spark, tmp_path):
    rows = [(i, date(1900 + 10 * i, 1, 1)) for i in range(11)] + [(99, None)]
    spark.createDataFrame(rows, "id bigint, birth_date date").write.parquet(str(tmp_path / "r"))
    sql.register_residents(spark, spark.read.parquet(str(tmp_path / "r")))
    ids = lambda call: sorted(r["id"] for r in spark.sql(f"select id from {call}").collect())
    assert ids("residents_aged(60, null, date'2000-06-01')") == [0, 1, 2, 3, 4] and ids("residents_aged(null, 9, date'2000-06-01')") == [10]
    assert ids("residents_aged(null, null, date'2000-06-01')") == list(range(11))
    plan = spark.sql("select id from residents_aged(60, 69, date'2000-06-01')")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(birth_date,1940-06-01)" in plan and "GreaterThan(birth_date,1930-06-01)" in plan
