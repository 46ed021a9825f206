"""Review of parsed households before they are saved: corrections laid over parsed values, and validation with one message per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspark.functions import expr as E
from hearthspark.operators.quality import blank, is_id16
from hearthspark.schemas import FAMILY_RELATION, GENDER, MARITAL_STATUS

# Fields of a member in the order they are checked, with the labels of their messages.
MEMBER_FIELDS = {
    "nik": "NIK", "nama": "Nama", "gender": "Jenis kelamin", "birth_place": "Tempat lahir", "birth_date": "Tanggal lahir", "religion": "Agama", "education": "Pendidikan",
    "occupation": "Pekerjaan", "marital_status": "Status perkawinan", "family_relation": "Status hubungan keluarga",
}
DOMAINS = {"gender": [*GENDER], "marital_status": [*MARITAL_STATUS], "family_relation": [*FAMILY_RELATION]}


def valid_birth_date(text: Column, newest_year: int) -> Column:
    """Year-month-day with all digits, or day-month-year with dashes or slashes, whose years below 100 are of this century; a real day from 1900 on."""
    iso, other = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})$"
    own = F.regexp_extract(text, other, 3).try_cast("int")
    year = F.when(text.rlike(iso), F.regexp_extract(text, iso, 1).try_cast("int")).otherwise(F.when(own < 100, own + 2000).otherwise(own))
    part = lambda a, b: F.when(text.rlike(iso), F.regexp_extract(text, iso, a)).otherwise(F.regexp_extract(text, other, b))
    day = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), part(2, 2), part(3, 1)), "y-M-d")
    return F.coalesce((text.rlike(iso) | text.rlike(other)) & day.isNotNull() & year.between(1900, newest_year), F.lit(False))


def household_review_errors(kk_number: Column, address: Column, members: Column) -> Column:
    """(path, message) of a household's own fields."""
    told = lambda path, bad, text: F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(text).alias("message")))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    # The messages.
    rules = F.array(
        F.coalesce(told("kk_number", empty(kk_number), "Nomor KK wajib diisi"), told("kk_number", ~is_id16(kk_number), "Nomor KK harus 16 digit angka")),
        told("address", empty(address), "Alamat wajib diisi"), told("members", F.coalesce(F.size(members), F.lit(0)) <= 0, "Minimal satu anggota keluarga wajib diisi"),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def member_review_errors(member: Column, index: Column, newest_year: int) -> Column:
    """(path, message) of a member (struct of MEMBER_FIELDS) at ``index`` from 0."""

    def check(field: str, label: str) -> Column:
        value, who = member[field], F.concat(F.lit(f"{label} anggota ke-"), (index + 1).cast("string"))
        # The messages' endings.
        said = F.when(blank(value), " wajib diisi")
        if field == "nik":
            said = said.when(~is_id16(value), " harus 16 digit angka")
        elif field == "birth_date":
            said = said.when(~valid_birth_date(value, newest_year), " tidak valid")
        elif field in DOMAINS:
            said = said.when(~value.isin(DOMAINS[field]), " tidak dikenal")
        return F.when(said.isNotNull(), F.struct(F.concat(F.lit("members."), index.cast("string"), F.lit(f".{field}")).alias("path"), F.concat(who, said).alias("message")))

    return F.filter(F.array(*[check(f, label) for f, label in MEMBER_FIELDS.items()]), lambda x: x.isNotNull())


def review_errors(households: DataFrame, newest_year: int) -> DataFrame:
    """``households`` (id, kk_number, address, members) with ``errors``, the household's first, then the members' in order. One projection."""
    own = household_review_errors(F.col("kk_number"), F.col("address"), F.col("members"))
    of = F.flatten(F.transform("members", lambda m, i: member_review_errors(m, i, newest_year)))
    return households.withColumn("errors", F.concat(own, F.coalesce(of, F.expr("cast(array() as array<struct<path:string,message:string>>)"))))


def overlay_members(members: DataFrame, corrections: DataFrame, fields: list[str]) -> DataFrame:
    """``members`` (id, idx, fields) with ``corrections`` (id, idx, field, value, at) laid over them: the latest of a field wins, unknown fields are left out, an index
    that no member has is a new one. Corrections are turned into columns by one aggregate before they meet the members."""
    known = corrections.filter(F.col("field").isin(fields)).groupBy(F.col("id").alias("_id"), F.col("idx").alias("_idx"))
    wide = known.agg(*[F.max_by(F.struct("value"), F.when(F.col("field") == f, F.col("at"))).alias(f"_{f}") for f in fields])
    met = members.join(wide, (F.col("id") == F.col("_id")) & (F.col("idx") == F.col("_idx")), "full")
    return met.select(F.coalesce("id", "_id").alias("id"), F.coalesce("idx", "_idx").alias("idx"), *[F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")["value"]).otherwise(F.col(f)).alias(f) for f in fields])


def first_failure(members: DataFrame, lookups: dict[str, DataFrame], rules: dict[str, Column]) -> DataFrame:
    """Fail-fast save of households' members (id, idx, and what rules and lookups look at): (id, idx, message) of the first member that a rule
    (message: condition) or a lookup (column: names, compared as normalized keys) rejects; households without one are left out."""
    said = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), text) for text, bad in rules.items()], F.lit(None).cast("string"))
    rows = members.withColumn("_said", said)
    for column, names in lookups.items():
        keys = names.select(E.normalized_key(F.col("name")).alias("_n")).distinct().withColumn("_ok", F.lit(True))
        rows = rows.withColumn("_key", E.normalized_key(F.col(column))).join(keys, F.col("_key") == F.col("_n"), "left")
        rows = rows.withColumn("_said", F.coalesce("_said", F.when(F.col("_ok").isNull(), F.concat(F.lit(f"{column}: "), F.coalesce(column, F.lit("")))))).drop("_key", "_n", "_ok")
    first = rows.filter("_said is not null").groupBy("id").agg(F.min(F.struct("idx", "_said")).alias("f"))
    return first.select("id", "f.idx", F.col("f._said").alias("message"))


def first_messages(messages: DataFrame, key: str, order: str, text: str, n: int) -> DataFrame:
    """(key, messages): the first ``n`` of each key, in order. The rank's limit is applied in each task before the shuffle."""
    few = messages.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_rn") <= n)
    lists = few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rn", text))).alias("_m"))
    return lists.select(key, F.transform("_m", lambda x: x[text]).alias("messages"))
