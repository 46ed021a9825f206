import random

import numpy as np
import xxhash

from hearthspark.llm import graph, simhash


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_golay_tables():
    words = np.random.default_rng(0).integers(0, 1 << 23, 500)
    keys = simhash.segment_keys(words)
    own = simhash.decode(words)
    assert (keys[:, 0] == own).all()
    for b in range(23):  # a neighbour's own index is among a word's keys
        assert (keys == simhash.decode(words ^ (1 << b))[:, None]).any(axis=1).all()
    assert set((keys >= 0).sum(axis=1).tolist()) == {1, 6}


def test_pairs_within_three_bits_share_a_key():
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(300)]
    near = [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))) for f in fps]
    asked, stored = simhash.pair_keys(np.array(fps, np.uint64))[1], simhash.pair_keys(np.array(near, np.uint64))[0]
    assert all(set(a[a >= 0].tolist()) & set(s.tolist()) for a, s in zip(asked, stored, strict=True))


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(40, 200))) for _ in range(25)]
    texts = [None, "", "one", "One", "one two", " "]
    for t in base:
        texts.append(t)
        for _ in range(rng.randrange(4)):
            w = t.split()
            w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    texts += texts[:8]
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in simhash.digest(simhash.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string"))).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] > label[i]:
                    label[j], changed = label[i], True
    for i in range(len(texts)):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fps[i]:016x}", label[i])


def test_star_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "q r s t u v w")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.digest(simhash.near_duplicates(df)).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
