import random

import corpus_pipeline as p
from hearthspark.llm import jaccard, simhash


def brute_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    a, b = brute_set(a), brute_set(b)
    return bool(a) and 5 * len(a & b) >= 4 * len(a | b)


def planted():
    """Texts of which some are copies with words replaced, at similarities around 0.8 to 0.95."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(20):
        w = [word() for _ in range(rng.randrange(100, 300))]
        texts.append(" ".join(w) + " " + common)
        for edits in (1, 3, len(w) // 45, len(w) // 40, len(w) // 20):
            x = list(w)
            for i in rng.sample(range(len(x)), edits):
                x[i] = word()
            texts.append(" ".join(x) + " " + common)
    return [*texts, None, "", "two words", "two words again"]


def test_stage_leaves_no_near_copies(spark):
    texts = planted()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)
    narrow = sorted(r["doc_id"] for r in p.drop_near_duplicates(spark, docs, "").collect())
    missed = [(a, b) for a in narrow for b in narrow if a < b and similar(texts[a], texts[b])]
    assert any((simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())).bit_count() > 3 for a, b in missed)
    stage = dict(p.STAGES)["simhash near-dedup"]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    # Of each component of the brute-force pairs the smallest id stays.
    label = {i: i for i in narrow}
    while (new := {i: min([label[i], *(label[j] for j in narrow if similar(texts[i], texts[j]))]) for i in narrow}) != label:
        label = new
    assert not [(a, b) for a in left for b in left if a < b and similar(texts[a], texts[b])]
    assert {label[i] for i in narrow} <= left <= set(narrow) and len(left) < len(narrow)


def test_prefixes_meet_at_the_bound(spark):
    rows = [(i, t) for i, t in enumerate(planted())]
    gone = {r["rid"] for r in jaccard.near_copies(spark.createDataFrame(rows, "rid long, text string")).collect()}
    left = [t for i, t in rows if i not in gone]
    assert gone and not any(similar(a, b) for n, a in enumerate(left) for b in left[:n])
    assert jaccard.near_copies(spark.createDataFrame([], "rid long, text string")).count() == 0


def test_a_shingle_of_a_third_of_all_documents(spark):
    """Short texts that share their only rare shingles, compared in tiles; some of them are near copies."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    hot = [word() for _ in range(6)]
    texts = [" ".join(hot + [word() for _ in range(2)]) for _ in range(60)] + [" ".join(word() for _ in range(30)) for _ in range(120)]
    texts += [texts[3], texts[7] + " x", *(" ".join([*texts[100].split()[:-1], word()]) for _ in range(3))]
    rows = list(enumerate(texts))
    for tile in (5, jaccard.HOT):
        gone = {r["rid"] for r in jaccard.near_copies(spark.createDataFrame(rows, "rid long, text string"), tile).collect()}
        left = [t for i, t in rows if i not in gone]
        assert len(gone) >= 4 and not any(similar(a, b) for n, a in enumerate(left) for b in left[:n])
        assert all(any(similar(texts[i], t) for j, t in rows if j != i) for i in gone)


def test_sketches_never_lose_a_pair():
    rng = random.Random(3)
    for _ in range(300):
        a = {rng.getrandbits(64) for _ in range(rng.randrange(1, 700))}
        b = {x for x in a if rng.random() < 0.9} | {rng.getrandbits(64) for _ in range(rng.randrange(60))}
        if b:
            x, y = (jaccard.sketch(jaccard.np.array(sorted(s), jaccard.np.uint64)) for s in (a, b))
            assert jaccard.apart(x, y) <= len(a ^ b)
            assert 100 * len(a & b) < 80 * len(a | b) or len(a ^ b) <= jaccard.room(len(a), len(b))
    far = [jaccard.sketch(jaccard.np.array([rng.getrandbits(64) for _ in range(600)], jaccard.np.uint64)) for _ in range(2)]
    assert jaccard.apart(*far) > jaccard.room(600, 600)


def test_passages_of_many_texts_are_no_candidates(spark, monkeypatch):
    """A passage in each of many texts, where the counters' means hide it: candidates don't grow with its texts' square."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(20)]
    texts = [" ".join(passage + [word() for _ in range(60)]) for _ in range(90)]
    texts += [texts[3] + " x", " ".join([*texts[7].split()[:-1], word()])]
    pairs, checked = [], jaccard._checked
    monkeypatch.setattr(jaccard, "levels", lambda docs: jaccard.np.zeros(jaccard.COUNTERS, jaccard.np.int8))
    monkeypatch.setattr(jaccard, "_checked", lambda met, *rest: pairs.append(met.distinct().count()) or checked(met, *rest))
    gone = {r["rid"] for r in jaccard.near_copies(spark.createDataFrame(list(enumerate(texts)), "rid long, text string")).collect()}
    assert gone == {90, 91} and sum(pairs) < 3 * len(texts)
