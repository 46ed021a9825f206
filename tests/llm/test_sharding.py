from pyspark.sql import functions as F

from hearthspark.llm import sharding as s
from hearthspark.llm.common import fresh_dir


def docs(spark, n=400):
    rows = [(i if i % 50 else None, "t" * (i % 30), None, f"s{i % 3}", i) for i in range(n)]
    return spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_nothing_is_lost_and_tiers_merge(spark):
    df = docs(spark)
    store = s.ShardedTable(spark, fresh_dir(spark, "t"), df.schema, base_bytes=1000, target_bytes=5000)
    merges = 0
    for part in s.arrivals(df, "doc_id", 9):
        store.append(part)
        merges += store.compact()
    assert merges >= 2 and not store.due(store.runs()[1])
    assert store.read().exceptAll(df).count() == 0 == df.exceptAll(store.read()).count()
    big = [r for r in store.runs()[1] if r.rows > 150]
    assert big and all(r.files <= -(-r.bytes // 2500) for r in big)
    before = store.versions()[-1]
    assert store.vacuum() > 0 and store.versions() == [before] and store.read().count() == df.count()


def test_versions_are_whole_and_commits_exclusive(spark):
    df = docs(spark, 20)
    store = s.ShardedTable(spark, fresh_dir(spark, "t"), df.schema)
    other = s.ShardedTable(spark, store.root, df.schema)
    assert store.append(df) == 1 and other.append(df) == 2
    assert store.read(1).count() == 25 and store.read().count() == 50
    version, runs = store.runs()
    assert not other._commit(version, runs)  # taken


def test_empty(spark):
    df = docs(spark).limit(0)
    assert s.shard(df).count() == 0
    store = s.ShardedTable(spark, fresh_dir(spark, "t"), df.schema)
    assert store.append(df) == 1 and store.runs()[1] == [] and store.read().columns == df.columns
    assert s.shard(docs(spark)).filter(F.col("doc_id").isNull()).count() == 9
