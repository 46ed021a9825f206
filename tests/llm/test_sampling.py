import collections
import math
import os

import numpy as np
import pytest

from hearthspark.llm import sampling as s

pytestmark = pytest.mark.skipif(not os.path.exists(s.MODEL), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def v():
    return s.Vocabulary(*s.load_vocabulary(), 1.0)


@pytest.fixture(scope="module")
def exact(v):
    """Probabilities of all segmentations of a short text, by enumeration."""
    ids = {p: i for i, p in enumerate(s.load_vocabulary()[0]) if p}

    def paths(t):
        if not t:
            yield (), 0.0
        for n in range(1, len(t) + 1):
            if t[:n] in ids:
                for p, w in paths(t[n:]):
                    yield (ids[t[:n]], *p), w + math.log(v.weight[ids[t[:n]]])

    found = dict(paths("▁hello▁w"))
    z = math.log(sum(map(math.exp, found.values())))
    return {k: math.exp(w - z) for k, w in found.items()}


def draw(v, n, k):
    return s.sample_texts(v, ["hello w"] * n, np.random.default_rng(0).integers(0, 2**63, n).astype(np.uint64), k)


def test_samples_follow_the_distribution_without_replacement(v, exact):
    n = 12_000
    rows = [[tuple(ids.tolist()) for ids, _, _ in r] for r in draw(v, n, 3)]
    assert all(len(set(r)) == 3 for r in rows)
    first, top = collections.Counter(r[0] for r in rows), sorted(exact, key=exact.get)[-3:]
    for p in top:
        assert abs(first[p] / n - exact[p]) < 4 * math.sqrt(exact[p] / n)
    best = top[-1]
    after = collections.Counter(r[1] for r in rows if r[0] == best)
    for p in top[:-1]:
        want = exact[p] / (1 - exact[best])
        assert abs(after[p] / first[best] - want) < 4 * math.sqrt(want / first[best])


def test_log_probabilities_and_inclusion(v, exact):
    rows = draw(v, 4000, 3)
    assert all(abs(math.exp(lp) - exact[tuple(ids.tolist())]) < 1e-9 for r in rows for ids, lp, _ in r)
    assert abs(np.mean([sum(math.exp(lp) / q for _, lp, q in r) for r in rows]) - 1) < 0.02  # importance weights are unbiased
    full = draw(v, 1, len(exact) + 5)[0]
    assert len(full) == len(exact) and all(q == 1.0 for _, _, q in full)  # all of them, then no more


def test_round_trip_and_independence_of_batches(v):
    texts = ["", None, "a▁ \n x 日本😀  é", "  two  spaces ", "word " * 3000, "tab\tnew\r\nline", "\U0010ffff﷐ ÿ"]
    keys = np.arange(len(texts), dtype=np.uint64) * np.uint64(7919)
    whole = s.sample_texts(v, texts, keys, 3)
    for i, t in enumerate(texts):
        alone = s.sample_texts(v, [t], keys[i : i + 1], 3)[0]
        assert [x[0].tolist() for x in alone] == [x[0].tolist() for x in whole[i]]
        assert all(s.decode(v, ids) == (t or "") for ids, _, _ in whole[i])


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello world", 1), (1, "hello world", 1), (None, None, 2), (3, "x" * 30_000, 3)], "doc_id long, text string, samples int")
    got = s.encode_samples(df).collect()
    assert len(got) == 4 and got[0]["samples"] == got[1]["samples"] and all(x["exact"] for r in got for x in r["samples"])
    assert [len(r["samples"]) for r in got] == [3, 3, 1, 3]
    assert s.digest(s.encode_samples(df.limit(0))).count() == 0


def test_too_many_characters_are_refused():
    pieces = tuple("" if i < 256 else chr(0x4E00 + i) for i in range(256 + 4096))
    with pytest.raises(ValueError, match="4096 distinct characters"):
        s.Vocabulary(pieces, tuple(map(float, range(len(pieces)))), 0, 1.0)


def test_decoding_on_arrays_in_blocks(v, monkeypatch):
    """Blocks may end inside a character's bytes; empty pieces and no pieces do no harm."""
    monkeypatch.setattr(s, "_PIECES", 3)
    text = "naïve \U0001f600 " * 5 + s.MARK + " the end"
    (found,) = s.sample_texts(v, [text], np.array([7], np.uint64))
    for ids, _, _ in found:
        assert s.decode(v, ids) == text == b"".join(v.bytes[i] for i in ids.tolist()).decode()[1:]
    control = v.bytes.index(b"")
    assert s.decode(v, np.insert(found[0][0], 1, [control] * 4)) == text and s.decode(v, np.zeros(0, np.int32)) == ""
