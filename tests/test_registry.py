from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hearthspark.functions import expr as E
from hearthspark.operators import filters, membership, quality, reports, review, views
from hearthspark.schemas import GENDER, RESIDENT_STATUS, TABLES
from hearthspark.sources import exports

TODAY = date(2026, 8, 7)


@pytest.fixture(scope="module")
def registry(spark):
    """Two areas, three RTs, three households, eight residents, two of them inactive."""
    t = {"area_units": [(1, "Lingkungan I", "lingkungan", None), (2, "4", "rw", None)], "rts": [(1, 1, "1"), (2, 1, "10"), (3, 2, "1")], "kartu_keluarga": [], "penduduk": []}
    for i, rt in ((1, 1), (2, 3), (3, None)):
        t["kartu_keluarga"].append((i, f"{i:016d}", f"Jl. {i}", rt, None, None, datetime(2026, 1, i), None))
    born = [date(1996, 8, 7), date(2021, 8, 7), date(2001, 8, 8), date(2016, 2, 29), date(2024, 1, 1), date(1950, 5, 5), date(1990, 1, 1), date(2000, 2, 29)]
    for i in range(8):
        t["penduduk"].append((
            i + 1, 1 if i < 4 else 2, f"{i + 1:016d}", f"Name {i}", "LAKI_LAKI" if i % 2 else "PEREMPUAN", "Kota", born[i], 1, None, None, "KAWIN", "KEPALA_KELUARGA" if i in (0, 4) else "ANAK", "O",
            {3: "PINDAH", 7: "MENINGGAL"}.get(i, "ACTIVE"), None, None, None, None, None, None, None, datetime(2026, 1, 1, 0, i), None,
        ))
    return {k: spark.createDataFrame(v, TABLES[k]) for k, v in t.items()} | {"religions": spark.createDataFrame([(1, "Islam")], TABLES["religions"])}


@pytest.fixture(scope="module")
def view(registry):
    r = registry
    return views.resident_view(r["penduduk"], r["kartu_keluarga"], r["rts"], r["area_units"], {"religion": r["religions"]}).cache()


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_age_filters(view):
    pick = lambda **kw: ids(filters.apply_filters(view, filters.FilterSpec(**kw), TODAY))
    assert pick(age=30) == [1] and pick(age=24) == [3] and pick(age_min=20, age_max=30) == [1, 3, 8] and pick(preset="balita") == [2, 5] and pick(preset="lansia") == [6]
    assert pick(age=30, age_min=0, age_max=5) == [1]  # the exact age wins
    assert pick() == list(range(1, 9)) and pick(query="  ") == list(range(1, 9))
    ages = {r["id"]: r["a"] for r in view.select("id", E.age_years(F.col("birth_date"), TODAY).alias("a")).collect()}
    assert all(pick(age=a) == sorted(i for i in ages if ages[i] == a) for a in set(ages.values()))


def test_leap_day(spark):
    df = spark.createDataFrame([(date(2000, 2, 29),)], "b date")
    assert df.select(E.age_years(F.col("b"), date(2023, 2, 28)).alias("a")).first()["a"] == 22
    assert df.filter(E.age_between(F.col("b"), date(2023, 3, 1), 23, 23)).count() == 1


def test_named_filters_and_searches(view):
    pick = lambda **kw: ids(filters.apply_filters(view, filters.FilterSpec(**kw), TODAY))
    assert pick(rt_id=1) == [1, 2, 3, 4] and pick(rt_number="1") == list(range(1, 9))  # numbers repeat across areas
    assert pick(area_unit_id=2) == [5, 6, 7, 8] and pick(gender="LAKI_LAKI", resident_status="ACTIVE") == [2, 6]
    assert pick(query="name 3") == [4] and pick(query="lingkungan") == [1, 2, 3, 4] and pick(kk_number="02") == [5, 6, 7, 8]
    assert ids(filters.search_words(view, "name lingkungan", filters.SEARCH_LIST)) == [1, 2, 3, 4]
    assert ids(filters.apply_filters(view, filters.FilterSpec(query="lingkungan"), TODAY, filters.SEARCH_EXPORT)) == []
    assert ids(view.filter(E.contains_any([F.col("full_name")], "e_3"))) == [4] and ids(view.filter(E.contains_any([F.col("full_name")], "e_3", escape=True))) == []


def test_slug():
    assert filters.FilterSpec(gender="LAKI_LAKI", resident_status="ACTIVE").file_name("pdf", TODAY) == "2026-08-07_jk-laki-laki_status-aktif.pdf"
    assert filters.FilterSpec().file_name("pdf", TODAY) == "2026-08-07_semua.pdf" and filters.FilterSpec(age_min=5).slug() == "usia-5tomax"


def test_counts(registry, view):
    total = lambda df: [tuple(r) for r in df.collect()]
    assert total(reports.count_by_domain(view, "gender", list(GENDER), "gender")) == [("LAKI_LAKI", 4), ("PEREMPUAN", 4)]
    assert total(reports.count_by_domain(view, "resident_status", list(RESIDENT_STATUS), "s")) == [("ACTIVE", 6), ("PINDAH", 1), ("MENINGGAL", 1)]
    areas = registry["area_units"].withColumn("label", E.area_label(F.col("type"), F.col("code"), F.col("name")))
    active = view.filter("resident_status = 'ACTIVE'")
    assert total(reports.count_by_rt(active, registry["rts"], areas)) == [("Lingkungan I / RT 1", 3), ("Lingkungan I / RT 10", 0), ("RW 4 / RT 1", 3)]
    kpi = reports.kpi_overview(registry["kartu_keluarga"], view, registry["rts"], F.col("resident_status") == "ACTIVE", F.col("marital_status") == "BELUM_KAWIN").first()
    assert tuple(kpi) == (3, 6, 0, 3)
    newest = reports.recent_activity([("penduduk", registry["penduduk"], "id", "created_at")]).collect()
    assert [r["id"] for r in newest] == [8, 7, 6, 5, 4]


def test_households(registry):
    r = registry
    heads = r["penduduk"].filter("family_relation = 'KEPALA_KELUARGA'")
    search = lambda q: ids(filters.household_search(r["kartu_keluarga"], heads, q, ["kk_number", "address", "postal_code"], "id", "kk_id", ["full_name"]))
    assert search("name 0") == [1] and search("name 1") == [] and search("jl. 3") == [3] and search(" ") == [1, 2, 3]
    active = r["penduduk"].filter("resident_status = 'ACTIVE'")
    assert ids(filters.active_households(r["kartu_keluarga"], active, r["penduduk"], "id", "kk_id")) == [1, 2, 3]
    guard = {x["id"]: x["verdict"] for x in views.delete_guard(r["kartu_keluarga"], "id", [("MEMBERS", r["penduduk"], "kk_id")]).collect()}
    assert guard == {1: "MEMBERS", 2: "MEMBERS", 3: "DELETABLE"}
    assert {x["kk_id"]: x["head"] for x in views.head_of_household(r["penduduk"]).collect()} == {1: 1, 2: 5}


def test_membership_move(spark):
    rows = [(1, 10, 7, "ANAK", "AKTIF", date(2020, 1, 1), None), (2, 11, 8, "ANAK", "AKTIF", date(2020, 1, 1), None), (3, 12, 9, "ISTRI", "KELUAR", date(2019, 1, 1), date(2020, 1, 1))]
    now = spark.createDataFrame(rows, TABLES["kk_anggota"])
    moves = spark.createDataFrame([(7, 20, "ISTRI"), (8, 11, "CUCU"), (9, 12, "ANAK")], "penduduk_id long, kk_id long, family_relation string")
    got = sorted(((r["penduduk_id"], r["kk_id"], r["family_relation"], r["status"], r["end_date"]) for r in membership.apply_moves(now, moves, TODAY).collect()), key=str)
    assert got == sorted([(7, 10, "ANAK", "KELUAR", TODAY), (7, 20, "ISTRI", "AKTIF", None), (8, 11, "CUCU", "AKTIF", None), (9, 12, "ISTRI", "KELUAR", date(2020, 1, 1)), (9, 12, "ANAK", "AKTIF", None)], key=str)
    assert quality.several_active(membership.apply_moves(now, moves, TODAY)).count() == 0


def test_plans(spark):
    known = spark.createDataFrame([("a", 1, True), ("b", 1, False)], "nik string, kk_id long, active boolean")
    incoming = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "nik string, kk_id long")
    plan = lambda mode: {r["nik"]: r["action"] for r in membership.upsert_plan(incoming, known, mode).collect()}
    assert plan("reject") == {"a": "DUPLICATE", "b": "DUPLICATE", "c": "INSERT"}
    assert plan("move_active") == {"a": "KEEP", "b": "REJECT_INACTIVE", "c": "INSERT"}
    assert plan("force_active") == {"a": "MOVE_AND_ACTIVATE", "b": "MOVE_AND_ACTIVATE", "c": "INSERT"}
    with pytest.raises(ValueError):
        membership.upsert_plan(incoming, known, "x")
    batch = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (2, 0, "z"), (2, 1, "a"), (3, 0, "q")], "batch_id long, idx int, nik string")
    assert {r["batch_id"]: r["duplicate_nik"] for r in membership.duplicate_in_import(batch, known).collect()} == {1: "x", 2: "a"}


def test_quality(registry, spark):
    bad = registry["penduduk"].withColumn("nik", F.when(F.col("id") == 1, "12").otherwise(F.col("nik")))
    got = {r["id"]: [e["path"] for e in r["e"]] for r in bad.select("id", quality.resident_errors(TODAY).alias("e")).collect()}
    assert got[1] == ["nik"] and got[4] == ["moved_at"] and got[8] == ["deceased_at"] and got[2] == []
    assert quality.dangling(registry["penduduk"].withColumn("kk_id", F.col("id")), registry["kartu_keluarga"], "kk_id").count() == 5
    assert registry["kartu_keluarga"].filter(F.size(quality.household_errors()) > 0).count() == 0


def test_helpers(spark):
    df = spark.createDataFrame([("SLTA/SEDERAJAT kota", "RT 10", "rw 05", 1234567, " laki-laki ", "LAKI_LAKI", "3-4-69", "31-02-2000")], "a string, b string, c string, n long, g string, x string, d string, e string")
    r = df.select(
        E.title_case(F.col("a")), E.natural_sort_key(F.col("b")), E.area_label(F.lit("RW"), F.lit(None), F.col("c")), E.format_count(F.col("n"), " jiwa"), E.canonical_enum(F.col("g")), E.canonical_enum(F.col("x")),
        E.parse_date(F.col("d")), E.parse_date(F.col("e")), E.pad_left(F.lit("123"), 2), E.rt_rw_label(F.lit(None).cast("string"), F.lit("2")), E.rt_rw_label(F.lit(None).cast("string"), F.lit(None).cast("string")),
    ).first()
    assert tuple(r) == ("Slta/Sederajat Kota", "rt 00000000000000000010", "rw 05", "1.234.567 jiwa", "LAKI_LAKI", None, date(2069, 4, 3), None, "123", "RT 2", None)


def test_export_and_snapshot(view, spark, tmp_path):
    rows = exports.export_rows(view.filter("id = 5"), TODAY)
    assert rows.columns[0] == "NIK" and list(rows.first()) == ["0000000000000005", "Name 4", "0000000000000002", "Perempuan", "Kota", "01-01-2024", "2", "1", "RW 4", "Aktif", "Islam", "-", "-"]
    assert exports.write_xlsx(exports.export_rows(view, TODAY), str(tmp_path / "x.xlsx")) == 8 and len(exports.read_xlsx(str(tmp_path / "x.xlsx"))) == 9
    exports.write_csv(rows, str(tmp_path / "csv"), single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == rows.columns
    exports.write_snapshot({"r": rows, "e": rows.limit(0)}, str(tmp_path / "snap"))
    back = exports.read_snapshot(spark, str(tmp_path / "snap"))
    assert back["r"].count() == 1 and back["e"].count() == 0
    entries = spark.createDataFrame([("database.sql", 10), ("../x", 5)], "name string, size long")
    assert not exports.archive_summary(entries, ["database.sql"]).first()["ok"] and exports.archive_summary(entries.limit(1), ["database.sql"]).first()["ok"]


def test_streaming_ingest(spark, tmp_path):
    from hearthspark.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    line = '{"id": "%s", "raw_text": "NOMOR KK : 3207122801160001", "confidence": 80, "arrived": "2026-01-01T00:00:00Z"}\n'
    (tmp_path / "in/a.json").write_text(line % "a" + line % "b")
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), 2026).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["kk_number"] == "3207122801160001"


def test_session_in_use_is_left_alone(spark):
    from hearthspark.session import get_session

    spark.conf.set("spark.sql.shuffle.partitions", 77)
    try:
        assert get_session("other") is spark or get_session("other").conf.get("spark.sql.shuffle.partitions") == "77"
        assert spark.conf.get("spark.sql.shuffle.partitions") == "77"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_birth_dates_under_review(spark):
    cases = {"2001-02-28": True, "2001-02-30": False, "28/02/2001": True, "1-2-99": False, "1-2-26": True, "01.02.2001": False, "1899-12-31": False, "2027-01-01": False, "5/5/05": True, "2001-2-3": False, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["ok"] for r in df.select("t", review.valid_birth_date(F.col("t"), 2026).alias("ok")).collect()}
    assert got == cases


def test_search_text_with_a_backslash(spark):
    df = spark.createDataFrame([(1, "a\\b_c"), (2, "ab")], "id long, t string")
    assert ids(df.filter(E.contains_any([F.col("t")], "a\\b"))) == [1] and ids(df.filter(E.contains_any([F.col("t")], "\\B_", escape=True))) == [1]


def test_inventory_is_of_every_file(spark, tmp_path):
    import hashlib

    (tmp_path / "sub").mkdir()
    for name, data in {"a.pdf": b"%PDF-1", "sub/b.png": b"\x89PNG\r\n\x1a\nxx", "sub/c": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {(r["path"].rsplit("/", 1)[-1], r["size"], r["sha256"], r["mime_type"]) for r in exports.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {("a.pdf", 6, hashlib.sha256(b"%PDF-1").hexdigest(), "application/pdf"), ("b.png", 10, hashlib.sha256(b"\x89PNG\r\n\x1a\nxx").hexdigest(), "image/png")}  # Spark's scans leave empty files out


def test_inventory_of_long_files_is_a_relay(spark, tmp_path, monkeypatch):
    """A task reads a bounded part of a file; digests are those of whole files."""
    import hashlib

    from hearthspark.sources import digests

    data = {f"long {n} %41é.bin": bytes((i * i + n) % 251 for i in range(n)) for n in (1, 63, 999, 1000, 1001, 2000, 5003)}
    for name, value in data.items():
        (tmp_path / name).write_bytes(value)
    want = {(name, len(value), hashlib.sha256(value).hexdigest(), None) for name, value in data.items()}
    got = exports.file_inventory(spark, str(tmp_path), hop=1000)
    assert {(r["path"].rsplit("/", 1)[-1], *r[1:]) for r in got.collect()} == want and got.count() == len(want)
    path, parts, at, state, head, sha = f"file:{tmp_path}/long 5003 %41é.bin", [], 0, None, None, None
    while sha is None:
        at, state, head, sha = digests.hashed(path, 5003, at, state, head, 1000)
        parts.append(at)
    assert parts == [1000, 2000, 3000, 4000, 5000, 5003] and sha == hashlib.sha256(data["long 5003 %41é.bin"]).hexdigest() and head == data["long 5003 %41é.bin"][:16]
    monkeypatch.setattr(digests, "_library", lambda: None)
    assert digests.hashed(path, 5003, 1000, b"", head, 1000) == (5003, None, head, sha)
