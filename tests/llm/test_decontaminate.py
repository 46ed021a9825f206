import hashlib
import random
import re

import pytest

from hearthspark.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(texts, items):
    windows = {}
    for key, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(max(0, len(w) - 12) or 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(key)
    out = []
    for t in texts:
        w, hit, seen = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    seen |= found
        out.append((len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def _case(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["É", "naïve", "x1"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(rng.choice([3, 7, 12, 13, 14, 20, 40])) for _ in range(8)]
    texts = []
    for _ in range(25):
        t = say(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            x = rng.choice(items)
            a = rng.randrange(len(x))
            t += x[a : a + rng.choice([11, 12, 13, 14, 30])] + say(2)
        texts.append(rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in t))
    return [*texts, None, "", "...", texts[0]], [(str(i), " ".join(x)) for i, x in enumerate(items)] + [("", None), ("9", "")]


@pytest.mark.parametrize("limit", [d.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, limit):
    texts, items = _case(seed)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, span int")
    bench = spark.createDataFrame([(int(k) if k else None, t) for k, t in items], "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in d.digest(d.find_contamination(docs, bench, broadcast_rows=limit)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.digest(d.find_contamination(docs, bench)).first()["n_hit"] == 0
    assert d.digest(d.find_contamination(docs.limit(0), bench)).count() == 0
