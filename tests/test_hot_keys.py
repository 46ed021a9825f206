"""Operators on persons and values that may hold any share of the rows, against plain versions; none of them windows over such a key."""

import random
from datetime import date, timedelta

import pytest

from hearthspark.operators import membership, quality, views

DAY = date(2024, 1, 1)
MEMBER = "id long, kk_id long, penduduk_id long, family_relation string, status string, effective_date date, end_date date"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def memberships(rng, n):
    """Person 1 has half of the rows; dates repeat, some are missing."""
    day = lambda: rng.choice([None, *[DAY + timedelta(rng.randrange(60)) for _ in range(6)]])
    return [(i, rng.randrange(4), rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["ANAK", "ISTRI"]), rng.choice(["AKTIF", "KELUAR"]), day(), day()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping(spark, seed):
    data = memberships(random.Random(seed), 80)
    want, order = [], lambda r: (r[5] is not None, r[5] or DAY, r[0])
    for person in {r[2] for r in data}:
        own = sorted((r for r in data if r[2] == person), key=order)
        want += [r for before, r in zip(own, own[1:]) if before[6] and r[5] and r[5] < before[6]]
    df = spark.createDataFrame(data, MEMBER)
    got = quality.overlapping(df)
    assert got.columns == df.columns and rows(got) == sorted(want, key=repr) and want
    assert quality.overlapping(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_apply_moves(spark, seed):
    data, on = memberships(random.Random(seed), 60), DAY + timedelta(100)
    moves = {1: (2, "MOVED"), 3: (1, "MOVED"), 77: (0, "MOVED")}
    want = []
    for person, (kk, relation) in moves.items():
        here = [r[0] for r in data if r[2] == person and r[4] == "AKTIF" and r[1] == kk]
        if not here:
            want.append((None, kk, person, relation, "AKTIF", on, None))
        for r in data:
            if r[2] == person:
                keep = bool(here) and r[0] == min(here)
                close = r[4] == "AKTIF" and not keep
                want.append((r[0], r[1], r[2], relation if keep else r[3], "KELUAR" if close else r[4], r[5], None if keep else on if close else r[6]))
    want += [r for r in data if r[2] not in moves]
    moved = spark.createDataFrame([(p, kk, rel) for p, (kk, rel) in moves.items()], "penduduk_id long, kk_id long, family_relation string")
    assert rows(membership.apply_moves(spark.createDataFrame(data, MEMBER), moved, on)) == sorted(want, key=repr)


def test_active_version(spark):
    data = [(i, None if i % 7 == 0 else i % 3, "x" if i % 2 else None) for i in range(40)] + [(None, 1, "x"), (None, 99, "y")]
    df = spark.createDataFrame(data, "id long, k long, t string")
    best = {}
    for i, k, t in data:
        if i is not None:
            best[k, t] = max(best.get((k, t), -1), i)
    got = views.active_version(df, ["k", "t"], "id")
    assert rows(got) == sorted([(i, k, t, i is not None and best[k, t] == i) for i, k, t in data], key=repr)


def test_duplicates_of_an_import(spark):
    rng = random.Random(5)
    data = [(b, i, rng.choice(["a", "b", "c", "d", f"u{i}"])) for b in range(6) for i in range(9)]
    data += [(2, 0, data[18][2])]  # the same row again
    known, want = {"c"}, {}
    for b in range(6):
        own = [n for x, _, n in sorted(data, key=lambda r: r[:2]) if x == b]
        again = next((n for i, n in enumerate(own) if n in own[:i]), None)
        first = again or next((n for n in own if n in known), None)
        if first:
            want[b] = first
    got = membership.duplicate_in_import(spark.createDataFrame(data, "batch_id int, idx int, nik string"), spark.createDataFrame([("c",)], "nik string"))
    assert {r["batch_id"]: r["duplicate_nik"] for r in got.collect()} == want


def test_numbered_by(spark):
    keys = [f"k{i:04d}" for i in range(500)]
    random.Random(6).shuffle(keys)
    got = views.numbered_by(spark.createDataFrame([(k,) for k in keys], "k string").repartition(5), "k", "n")
    assert {r["k"]: r["n"] for r in got.collect()} == {k: i for i, k in enumerate(sorted(keys), 1)}
    assert views.numbered_by(spark.createDataFrame([], "k string"), "k", "n").count() == 0


def test_no_window_over_a_person(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", "AKTIF", DAY, None)], MEMBER)
    moves = spark.createDataFrame([(1, 2, "b")], "penduduk_id long, kk_id long, family_relation string")
    for found in (membership.apply_moves(df, moves, DAY), views.active_version(df, ["penduduk_id"], "id")):
        assert "Window" not in found._jdf.queryExecution().toString()
