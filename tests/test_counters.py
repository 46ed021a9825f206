"""Counts kept up to date against recounts."""

import random
from collections import Counter

import pytest

from hearthspark.operators import counters
from hearthspark.sources import versions

ROW = "struct<area:string,status:string>"
DIMENSIONS = {"area": "area", "status": "status"}


def changes(spark, pairs):
    return spark.createDataFrame(pairs, f"before {ROW}, after {ROW}")


def recount(people):
    return {(d, v): n for i, d in enumerate(DIMENSIONS) for v, n in Counter(p[i] for p in people.values()).items()}


def kept(spark, root):
    return {(r["dimension"], r["value"]): r["n"] for r in counters.counts(spark, root).collect()}


def test_batches_equal_recounts(spark, tmp_path):
    rng, root = random.Random(7), f"file://{tmp_path}/c"
    # The areas repeat values of the other dimension; a third of all persons live in one.
    some = lambda: (rng.choice(["a", "a", "b", "", None, "ACTIVE"]), rng.choice(["ACTIVE", "MOVED", None]))
    people = {i: some() for i in range(60)}
    counters.create(spark.createDataFrame(list(people.values()), "area string, status string"), DIMENSIONS, root)
    assert kept(spark, root) == recount(people)
    for batch in range(4):
        pairs = []
        for i in rng.sample(range(80), 25):
            before, after = people.get(i), rng.choice([None, some()])
            pairs.append((before, after))
            people.pop(i, None)
            if after:
                people[i] = after
        assert counters.update(spark, root, str(batch), changes(spark, pairs), DIMENSIONS)
        assert kept(spark, root) == recount(people)
        if batch % 2:
            assert not counters.update(spark, root, str(batch), changes(spark, pairs), DIMENSIONS)
            assert kept(spark, root) == recount(people)


def test_a_batch_of_two_writers_counts_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/c"
    counters.create(spark.createDataFrame([("a", "x")] * 3, "area string, status string"), DIMENSIONS, root)
    batch, applied = changes(spark, [(("a", "x"), ("b", "x"))]), []
    plain = counters.apply_deltas

    def slow(state, change):
        """While this writer works, another one commits the same batch."""
        if not applied:
            applied.append(True)
            applied.append(counters.update(spark, root, "one", batch, DIMENSIONS))
        return plain(state, change)

    monkeypatch.setattr(counters, "apply_deltas", slow)
    assert counters.update(spark, root, "one", batch, DIMENSIONS) is False and applied == [True, True]
    assert kept(spark, root) == {("area", "a"): 2, ("area", "b"): 1, ("status", "x"): 3}


def test_cases(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    counters.create(spark.createDataFrame([], "area string, status string"), DIMENSIONS, root)
    assert kept(spark, root) == {}
    assert counters.update(spark, root, "none", changes(spark, []), DIMENSIONS) and kept(spark, root) == {}
    assert counters.update(spark, root, "same", changes(spark, [(("a", "x"), ("a", "x")), (None, None)]), DIMENSIONS) and kept(spark, root) == {}
    before = versions.latest(spark, root)
    with pytest.raises(Exception, match="fewer than none"):
        counters.update(spark, root, "wrong", changes(spark, [(("a", "x"), None)]), DIMENSIONS)
    assert versions.latest(spark, root) == before
