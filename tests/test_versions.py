"""Versions, long histories, indexes, pages and snapshots against plain versions of themselves."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthspark.functions import expr as E
from hearthspark.operators import lookup, membership
from hearthspark.sources import snapshots, versions

RESIDENT = "nik long, kk_id long, resident_status string, moved_at date"


def residents(spark, n):
    return spark.createDataFrame([(i, i % 7, "ACTIVE" if i % 3 else "PINDAH", None) for i in range(n)], RESIDENT)


def incoming(spark, *pairs):
    return spark.createDataFrame(list(pairs), "nik long, kk_id long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def paths(spark, root, version):
    return {r["path"] for r in versions.files(spark, root, version).collect()}


def test_merge_rewrites_only_touched_files(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert versions.latest(spark, root) is None
    versions.create(residents(spark, 400), root, "nik", file_rows=50)
    before = paths(spark, root, 0)
    assert len(before) > 4
    change = incoming(spark, (10, 99), (12, 98), (1000, 97))
    assert versions.merge(spark, root, "nik", change, membership.apply_upsert, file_rows=50) == 1
    after = paths(spark, root, 1)
    assert len(before - after) == 1 and len(before & after) == len(before) - 1
    assert rows(versions.read(spark, root)) == rows(membership.apply_upsert(residents(spark, 400), change))
    assert rows(versions.read(spark, root, 0)) == rows(residents(spark, 400))
    # No changes commit nothing.
    assert versions.merge(spark, root, "nik", incoming(spark).filter("nik > 0"), membership.apply_upsert) == 1
    with pytest.raises(versions.Conflict):
        versions.create(residents(spark, 1), root, "nik")


def test_of_two_merges_one_replays(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    versions.create(residents(spark, 100), root, "nik", file_rows=20)
    one, two = incoming(spark, (10, 50), (11, 51)), incoming(spark, (10, 60), (95, 61), (200, 62))
    seen = []

    def slow(known, changes):
        """While this merge works, the other one commits."""
        if not seen:
            seen.append(versions.merge(spark, root, "nik", one, membership.apply_upsert))
        return membership.apply_upsert(known, changes)

    assert versions.merge(spark, root, "nik", two, slow) == 2 and seen == [1]
    want = membership.apply_upsert(membership.apply_upsert(residents(spark, 100), one), two)
    assert rows(versions.read(spark, root)) == rows(want)
    with pytest.raises(versions.Conflict):
        versions.merge_onto(spark, root, "nik", one, membership.apply_upsert, 1)
    assert versions.latest(spark, root) == 2 and rows(versions.read(spark, root)) == rows(want)


def test_merge_with_null_keys_and_empty_tables(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    versions.create(residents(spark, 0), root, "nik")
    assert versions.read(spark, root).count() == 0
    versions.merge(spark, root, "nik", incoming(spark, (1, 2), (None, 3)), lambda known, new: known.unionByName(new, allowMissingColumns=True))
    versions.merge(spark, root, "nik", incoming(spark, (None, 4)), lambda known, new: known.unionByName(new, allowMissingColumns=True))
    assert [r[:2] for r in rows(versions.read(spark, root))] == [(1, 2), (None, 3), (None, 4)]


@pytest.mark.parametrize("per_task", [1_000_000, 40])
def test_following_of_a_hot_person(spark, per_task):
    rng, start = random.Random(8), datetime(2020, 1, 1)
    data = [(i, rng.choice([1, 1, 1, 2, 3, None, 40 + i]), start + timedelta(hours=rng.randrange(50)), i % 5) for i in range(600)]
    df = spark.createDataFrame([(i, p, None if i % 17 == 0 else t, k) for i, p, t, k in data], "id long, p long, ts timestamp, k int")
    want = membership.history(df, "p", ["ts", "id"], "ts")
    got = membership.history(df, "p", ["ts", "id"], "ts", per_task)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert membership.history(df.limit(0), "p", ["ts", "id"], "ts").count() == 0


def test_a_hot_person_spreads_over_tasks(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("p"), F.timestamp_seconds("id").alias("ts"))
    dealt = df.repartitionByRange(8, "p", "ts", "id").withColumn("t", F.spark_partition_id()).filter("p = 7").groupBy("t").count().collect()
    assert len(dealt) >= 3 and max(r["count"] for r in dealt) < 700


def test_trigram_search_equals_scan(spark, tmp_path):
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("abAB%_\\éÉ ") for _ in range(rng.randrange(25)))
    df = spark.createDataFrame([(i, text(), None if i % 9 == 0 else text(), "x") for i in range(400)], "id long, a string, b string, key string").cache()
    root = f"file://{tmp_path}/grams"
    lookup.build_trigrams(df, "id", ["a", "b"], root, folders=16)
    for pattern in ["%", "_", "\\", "ab", "a%b", "AB_", "\\\\a", "é a", "aBa", "%_\\", "bab ", "zzz", "ÉÉ%aba", *(text()[:5] for _ in range(6))]:
        if pattern:
            for escape in (False, True):
                want = df.filter(E.contains_any([F.col("a"), F.col("b")], pattern, escape))
                assert rows(lookup.search(df, "id", ["a", "b"], pattern, root, escape, folders=16)) == rows(want), pattern
    every = spark.read.parquet(root)
    assert len(lookup.postings(spark, root, ["aba"], 16).inputFiles()) >= 1
    scanned = lookup.postings(spark, root, ["aba"], 16).select("key", F.input_file_name().alias("f")).select("f").distinct().count()
    assert scanned < len(every.inputFiles())


def test_every_page_equals_the_sorted_rows(spark, tmp_path):
    rng = random.Random(2)
    data = [(i, rng.choice([None, *range(20)])) for i in range(510)]
    df = spark.createDataFrame(data, "id long, v long")
    root = f"file://{tmp_path}/pages"
    lookup.build_pages(df, ["v", "id"], root, per_part=60)
    want = [tuple(r) for r in df.orderBy("v", "id").collect()]
    for number in (1, 2, 3, 11, 20, 21, 22, 99):
        assert [tuple(r) for r in lookup.page(spark, root, ["v", "id"], number).collect()] == want[(number - 1) * 25 : number * 25]
    read = lookup.page(spark, root, ["v", "id"], 11).select(F.input_file_name().alias("f")).distinct().count()
    assert read <= 2 < spark.read.parquet(f"{root}/directory").count()
    lookup.build_pages(df.limit(0), ["v", "id"], f"{root}-none")
    assert lookup.page(spark, f"{root}-none", ["v", "id"], 1).count() == 0


def test_snapshots_differ_where_their_rows_do(spark, tmp_path):
    schema = "k long, v string"
    old = spark.createDataFrame([(i, f"v{i}") for i in range(300)] + [(None, "null")], schema)
    new = old.filter("k is null or k <> 5").withColumn("v", F.when(F.col("k") == 9, "other").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(1000, "new")], schema))
    a, b, c = (f"file://{tmp_path}/{x}" for x in "abc")
    snapshots.write(old, "k", a)
    snapshots.write(new, "k", b)
    snapshots.write(old.repartition(3), "k", c)
    assert snapshots.differing(spark, a, c) == [] and snapshots.differences(spark, a, c, schema, "k").count() == 0
    want = spark.createDataFrame([(5,), (9,), (1000,)], "k long").select(snapshots.bucket_of("k")).distinct()
    where = snapshots.differing(spark, a, b)
    assert where == sorted(r[0] for r in want.collect()) and len(where) <= 3
    assert rows(snapshots.differences(spark, a, b, schema, "k")) == [(1000, "added"), (5, "removed"), (9, "changed")]
    assert rows(snapshots.restored(spark, a, b, schema)) == rows(old)
    folders = {f.split("bucket=")[1].split("/")[0] for r in snapshots.bucket_rows(spark, a, schema, where).select(F.input_file_name()).distinct().collect() for f in r}
    assert folders == {str(x) for x in where}
    # One bucket's change reaches the root.
    top = snapshots.tree(spark, a).agg(F.max("level")).first()[0]
    assert snapshots.tree(spark, a).filter(F.col("level") == top).count() == 1


def test_area_pairs(spark):
    cases = {
        "RT 01 RW 02": ("01", "02"), "rt.1/rw.22": ("1", "22"), "RT: 003 / RW: 004": ("003", "004"), "03/04": ("03", "04"), "1-2-3": ("1", "2"), "RT 5 - 6": ("5", "6"), "no 7 of 8": ("7", "8"),
        "RT 1": None, "": None, "a": None, "1 2 3": None, "12345": None, "1 1234": None, "RW 3 RT 4": ("3", "4"), "RT RW 5": None, "PART 1 ARW 2": ("1", "2"), "9999/1": ("999", "1"), "1/9999": ("1", "999"), None: None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", E.area_pair(F.col("t")).alias("p"))
    got = {r["t"]: None if r["p"] is None else tuple(r["p"]) for r in df.collect()}
    assert got == cases


def test_labels(spark):
    cases = {"ALAMAT : JL. 1": "JL. 1", "ALAMAT:x": "X", "ALAMAT I : Y": "Y", "alamat JL. 2": "JL. 2", "ALAMAT": "", "ALAMATNYA : Z": None, "ALAMAT KOTA : Z": "KOTA : Z", "NO": None, "ALAMAT 1: A:B": "A:B"}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", E.header_value(F.col("t"), "ALAMAT").alias("v"))
    assert {r["t"]: r["v"] for r in df.collect()} == cases


def test_hourly_activity_drops_what_is_later_than_the_watermark(spark, tmp_path):
    from hearthspark.streaming import ingest

    source, out = tmp_path / "in", str(tmp_path / "out")
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    batches = [[(at(1, 5), "a"), (at(1, 50), "a"), (at(2, 1), "b"), (None, "a")], [(at(5, 0), "a"), (at(1, 10), "a")], [(at(1, 20), "a"), (at(9, 0), "a")], [(at(20, 0), "z")]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "ts timestamp, kind string").coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema("ts timestamp, kind string").option("recursiveFileLookup", True).parquet(str(source))
        q = ingest.hourly_activity(stream, "ts", "kind").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    # 1:10 comes while its hour is open still, 1:20 after the watermark (4:00) closed it.
    assert rows(spark.read.parquet(out)) == sorted([(at(1, 0), "a", 3), (at(2, 0), "b", 1), (at(5, 0), "a", 1), (at(9, 0), "a", 1)], key=repr)
    whole = ingest.hourly_activity(spark.createDataFrame([r for b in batches for r in b], "ts timestamp, kind string"), "ts", "kind")
    assert (at(1, 0), "a", 4) in rows(whole)
