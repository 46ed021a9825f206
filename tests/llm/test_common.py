import random

import pytest
from pyspark.sql import functions as F

from hearthspark.llm import common


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_lookup_of_hot_keys(spark, small):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 7}", i) for i in range(70)] + [(None, i) for i in range(50)] + [("none", 1), ("hot", 1)]
    left = spark.createDataFrame([(k, i, "x") for k, i in rows], "k string, i long, v string").repartition(3)
    right = common.cut(spark.createDataFrame([("hot", 3001, "H"), *[(f"k{i}", 10, f"V{i}") for i in range(7)], ("spare", 5, "S")], "k string, n long, word string"))
    got = common.spread_lookup(left, right, "k", "n", "i", ["word"], small=small, per_task=100)
    want = [(k, i, "x", "H" if k == "hot" else f"V{k[1:]}" if k and k != "none" else None) for k, i in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    if not small:
        # The hot key's rows lie in many partitions.
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        dealt = common.spread_lookup(left, right, "k", "n", "i", ["word"], small=small, per_task=100)
        hot = dealt.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(hot) > 1 and max(r["count"] for r in hot) < 1500
    assert common.spread_lookup(left, right.limit(0), "k", "n", "i", ["word"], small=small).count() == len(rows)


def test_folders_on_a_cluster_must_be_named(spark, monkeypatch):
    path = common.fresh_dir(spark, "test")
    assert path.startswith("file://")
    spark.range(3).write.parquet(path)
    common.remove(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        common.remove(spark, path.replace("hearth-", "other-"))


def test_running_and_merged_match_plain_loops(spark):
    rng = random.Random(12)
    lists = [[], [(0, 1)], [(0, 5), (5, 6), (7, 9)]]
    for n in (3, 255, 256, 257, 1000):
        lists.append(sorted((s, s + rng.randrange(1, 6)) for s in (rng.randrange(4 * n) for _ in range(n))))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, spans array<struct<s:int,e:int>>")
    got = df.select("id", common.running(F.col("spans"), lambda x: x["e"] - x["s"], lambda a, b: a + b, 0).alias("sums"), *[common.merged(F.col("spans"), t).alias(f"m{t}") for t in (False, True)])
    for row in got.collect():
        spans = lists[row["id"]]
        assert row["sums"] == [sum(e - s for s, e in spans[:i]) for i in range(len(spans))]
        for touching in (False, True):
            want = []
            for s, e in spans:
                if want and (s <= want[-1][1] if touching else s < want[-1][1]):
                    want[-1][1] = max(want[-1][1], e)
                else:
                    want.append([s, e])
            assert [list(x) for x in row[f"m{touching}"]] == want
