"""Queries on scanned cards: every form of area numbers, repaired identifiers, labels, findings, joined lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthspark.functions import expr as E
from hearthspark.operators import household_text
from hearthspark.plans.catalog import household_texts, query
from hearthspark.sources.tables import table

c = F.col


def nth(values: list[str], key: str):
    """One of ``values`` by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c(key) % len(values) + 1).cast("int"))


_FORMS = ["RT {a} RW {b}", "rt: {a}, Rw.{b}", "{a}/{b}", "No. {a} - {b} / 9", "lorong {a} blok {b}", "RW {b} RT {a}", "RT {a}", "1 2 3", "-", "RT {a} / {b}", "rt {a} no 7 rw : {b}", "{a} 1234"]
_FOUND = "(case o_orderkey%12 when 6 then null when 7 then null when 8 then null when 11 then null when 5 then {five} else {else_} end)"


@query("rt_rw_forms", sql=f"select o_orderkey, {_FOUND.format(five='b', else_='a')} rt, {_FOUND.format(five='a', else_='b')} rw from (select o_orderkey, case when 1+o_orderkey%7<10 then '0' else '' end||(1+o_orderkey%7) a, cast(10+o_orderkey%90 as varchar) b from orders) z")
def rt_rw_forms(spark, d):
    """Area numbers in every form that cards have, labels in the wrong order (then the only two numbers count), and texts without a pair."""
    text = nth([f.replace("{a}", "\x01").replace("{b}", "\x02") for f in _FORMS], "o_orderkey")
    a, b = (1 + c("o_orderkey") % 7).cast("string"), (10 + c("o_orderkey") % 90).cast("string")
    rows = table(spark, d, "orders").select("o_orderkey", F.replace(F.replace(text, F.lit("\x01"), a), F.lit("\x02"), b).alias("t")).select("o_orderkey", E.area_pair(c("t")).alias("p"))
    return rows.select("o_orderkey", E.area_number(c("p.rt")).alias("rt"), E.area_number(c("p.rw")).alias("rw"))


@query("extract_id16_repaired", sql="select o_orderkey, case o_orderkey%4 when 3 then '' else lpad(cast(o_orderkey as varchar),16,'0') end k from orders")
def extract_id16_repaired(spark, d):
    """Sixteen digits of which some were read as letters, with separators between them; fifteen are none."""
    nik = E.pad_left(c("o_orderkey").cast("string"), 16)
    misread = F.when(c("o_orderkey") % 4 == 1, F.translate(nik, "0158", "OlSB")).when(c("o_orderkey") % 4 == 2, F.translate(nik, "015", "oIs")).when(c("o_orderkey") % 4 == 3, F.substring(nik, 2, 15)).otherwise(nik)
    mark = nth([".", " ", "-", "/"], "o_custkey")
    spread = F.concat(F.substring(misread, 1, 6), mark, F.substring(misread, 7, 6), mark, F.substring(misread, 13, 4))
    return table(spark, d, "orders").select("o_orderkey", E.id16(F.concat(F.lit("(*) "), spread)).alias("k"))


@query("header_labels", sql="select distinct o_custkey id, lpad(cast(o_custkey as varchar),16,'0') nomor_kk, 'JL. '||o_custkey alamat, '0'||(1+o_custkey%9)||'/'||(1+o_custkey%90) rt_rw, case o_custkey%3 when 0 then '' when 1 then 'MELATI '||o_custkey else 'MAWAR' end lingkungan from orders")
def header_labels(spark, d):
    """The values of a card's labels: with a colon, with a mark before it, after white space, or bare."""
    line = F.when(c("id") % 3 == 0, "Lingkungan").when(c("id") % 3 == 1, F.concat(F.lit("lingkungan I :  Melati "), c("id").cast("string"))).otherwise("LINGKUNGAN   Mawar")
    lines = household_texts(spark, d).select("id", F.explode(F.split(F.concat(line, F.lit("\n"), F.replace("raw_text", F.lit("NOMOR KK"), F.lit("N0MOR KK"))), "\n")).alias("line"))
    names = {"nomor_kk": "NOMOR KK", "alamat": "ALAMAT", "rt_rw": "RT/RW", "lingkungan": "LINGKUNGAN"}
    return lines.groupBy("id").agg(*[F.max(F.trim(E.header_value(c("line"), label))).alias(name) for name, label in names.items()])


_FINDINGS = """
with m as (select o_custkey id, count(*) filter (o_orderkey%3=1) heads, min(o_orderkey) first from orders group by o_custkey)
select id, 'warning' kind, 'Gambar tidak terbaca dengan baik (confidence sangat rendah).' message from m where id%7=0
union all select id, 'warning', 'Nomor KK tidak terbaca pada baris: 12' from m where id%5=0
union all select id, 'warning', 'Nilai RT/RW ditemukan tetapi formatnya tidak dikenali.' from m where id%4=0
union all select id, 'warning', 'NIK duplikat diabaikan: '||lpad(cast(first as varchar),16,'0') from m where id%3=0
union all select id, 'warning', 'Kepala Keluarga belum terbaca dari hasil OCR.' from m where heads=0
union all select id, 'error', 'Nomor KK tidak ditemukan atau tidak terbaca.' from m where id%5=0
union all select id, 'error', 'OCR menemukan lebih dari satu anggota dengan hubungan Kepala Keluarga. Periksa kembali sebelum menyimpan.' from m where heads>1
"""


@query("card_findings", sql=_FINDINGS)
def card_findings(spark, d):
    """Every warning and error of every card, some of them spoilt: number, area, a repeated member, poor scans."""
    again = F.concat(F.lit("\n"), F.regexp_extract("raw_text", "NO NAMA NIK\n([^\n]*)", 1))
    text = F.concat("raw_text", F.when(c("id") % 3 == 0, again).otherwise(""))
    text = F.when(c("id") % 4 == 0, F.regexp_replace(text, "RT/RW : [^\n]*", "RT/RW : tidak ada")).otherwise(text)
    text = F.when(c("id") % 5 == 0, F.regexp_replace(text, "NOMOR KK : [^\n]*", "NOMOR KK : 12")).otherwise(text)
    cards = household_texts(spark, d).select("id", text.alias("raw_text"), F.when(c("id") % 7 == 0, 20.0).otherwise(90.0).alias("confidence"))
    said = lambda kind, of: F.transform(of, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("message")))
    found = household_text.parse_households(cards, 2100).select("id", F.explode(F.concat(said("warning", "warnings"), said("error", "validation_errors"))).alias("f"))
    return found.select("id", "f.kind", "f.message")


_WRITTEN = ["Laki-laki", " perempuan ", "LAKI_LAKI", "Belum Kawin", "cerai mati", "BELUM_KAWIN", "Kepala Keluarga", "istri", "-", "--", "", "sepupu", "laki laki"]
_CODES = ["'LAKI_LAKI'", "'PEREMPUAN'", "null", "'BELUM_KAWIN'", "'CERAI_MATI'", "null", "'KEPALA_KELUARGA'", "'ISTRI'", "null", "null", "null", "null", "'LAKI_LAKI'"]


@query("canonical_labels", sql=f"select o_orderkey, case o_orderkey%13 {' '.join(f'when {i} then {code}' for i, code in enumerate(_CODES))} end code from orders")
def canonical_labels(spark, d):
    """Codes of labels as documents have them; raw codes, dashes and unknown words have none."""
    return table(spark, d, "orders").select("o_orderkey", E.canonical_enum(nth(_WRITTEN, "o_orderkey")).alias("code"))


@query("normalized_text", sql=r"select doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(text,chr(160),' '),chr(8203),''),chr(13)||chr(10),chr(10)),chr(13),chr(10)),chr(10)), lambda x: trim(regexp_replace(x,'[ \t]+',' ','g'))), lambda x: x<>''), '|'), '') lines, coalesce(array_to_string(list_filter(regexp_split_to_array(trim(text),'\s+'), lambda x: x <> ''), '|'), '') words from documents")
def normalized_text(spark, d):
    """What normalised lines and tokens hold, not only how many there are."""
    joined = lambda parts: F.array_join(parts, "|")
    return table(spark, d, "documents").select("doc_id", joined(E.normalize_lines(c("text"))).alias("lines"), joined(E.tokens(c("text"))).alias("words"))
