"""Row-level validation: each rule yields (path, message) or nothing; a row's errors are an array."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspark.operators.membership import following
from hearthspark.schemas import FAMILY_RELATION, GENDER, MARITAL_STATUS


def rule(bad: Column, path: str, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))


def errors(*rules: Column) -> Column:
    """The broken rules, in order."""
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def is_id16(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{16}$"), F.lit(False))


def resident_errors(as_of: date) -> Column:
    """Of a resident row: identifiers, domains, dates and what each status requires."""
    c, today = F.col, F.lit(as_of)
    # The messages.
    return errors(
        rule(~is_id16(c("nik")), "nik", "NIK harus 16 digit."),
        rule(blank(c("full_name")), "full_name", "Nama lengkap wajib diisi."),
        rule(~c("gender").isin(*GENDER) | c("gender").isNull(), "gender", "Jenis kelamin tidak valid."),
        rule(~c("marital_status").isin(*MARITAL_STATUS), "marital_status", "Status perkawinan tidak valid."),
        rule(~c("family_relation").isin(*FAMILY_RELATION), "family_relation", "Hubungan keluarga tidak valid."),
        rule(c("birth_date") > today, "birth_date", "Tanggal lahir melewati hari ini."),
        rule(c("moved_at") > today, "moved_at", "Tanggal pindah melewati hari ini."),
        rule(c("deceased_at") > today, "deceased_at", "Tanggal meninggal melewati hari ini."),
        rule((c("resident_status") == "PINDAH") & c("moved_at").isNull(), "moved_at", "Tanggal pindah wajib diisi."),
        rule((c("resident_status") == "MENINGGAL") & c("deceased_at").isNull(), "deceased_at", "Tanggal meninggal wajib diisi."),
        rule((c("resident_status") != "PINDAH") & c("moved_at").isNotNull(), "moved_at", "Tanggal pindah hanya untuk status pindah."),
        rule((c("resident_status") != "MENINGGAL") & c("deceased_at").isNotNull(), "deceased_at", "Tanggal meninggal hanya untuk status meninggal."),
    )


def household_errors() -> Column:
    c = F.col
    return errors(
        rule(~is_id16(c("kk_number")), "kk_number", "Nomor KK harus 16 digit."),
        rule(blank(c("address")), "address", "Alamat wajib diisi."),
        rule(F.length("address") > 255, "address", "Alamat paling panjang 255 karakter."),
        rule(~blank(c("postal_code")) & ~c("postal_code").rlike("^[0-9]{5}$"), "postal_code", "Kode pos harus 5 digit."),
    )


def duplicates_of(rows: DataFrame, column: str, id_: str) -> DataFrame:
    """Rows whose value another id has too."""
    n = rows.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows.join(n, F.col(column) == F.col("_v"), "left_semi")


def same_value_elsewhere(rows: DataFrame, column: str, id_: str, own: int) -> DataFrame:
    """One row ``n``: how many other rows have the value of row ``own``."""
    mine = rows.filter(F.col(id_) == own).select(F.col(column).alias("_v")).limit(1)
    return rows.filter(F.col(id_) != own).join(F.broadcast(mine), F.col(column) == F.col("_v"), "left_semi").agg(F.count(F.lit(1)).alias("n"))


def dangling(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent doesn't exist; null keys dangle from nothing."""
    return children.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def head_check(members: DataFrame, key: str, is_head: Column) -> DataFrame:
    """(key, st): NO_HEAD, OK or MULTI_HEAD."""
    h = members.groupBy(key).agg(F.count_if(is_head).alias("_h"))
    return h.select(key, F.when(F.col("_h") == 0, "NO_HEAD").when(F.col("_h") > 1, "MULTI_HEAD").otherwise("OK").alias("st"))


def several_active(memberships: DataFrame) -> DataFrame:
    """People with more than one active membership."""
    return memberships.filter("status = 'AKTIF'").groupBy("penduduk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def overlapping(memberships: DataFrame) -> DataFrame:
    """Memberships that begin before the person's previous one ends. A person may hold any share of the rows."""
    rows = following(memberships.withColumn("_row", F.struct(*memberships.columns)), "penduduk_id", ["effective_date", "id"], "_row", "_next")
    return rows.filter(F.col("_next.effective_date") < F.col("end_date")).select("_next.*")
