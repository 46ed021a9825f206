import random
import re
from collections import Counter, defaultdict

import pytest

from hearthspark.llm import collocations as c


def brute(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(x.lower() if x.isascii() else x for x in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if 2 <= len(p) <= 4 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def texts():
    rng = random.Random(4)
    vocabulary = [*"abcdefgh", "é", "x\x01", "x", "A-Z", "\U0001f600", "q\x1f"]
    out = [("en", " ".join(rng.choices(vocabulary, [9, 5, 3, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1], k=rng.randrange(40)))) for _ in range(120)]
    out = [(lang, "".join(rng.choice(" .\n\t ,") if x == " " and rng.random() < 0.2 else x for x in t)) for lang, t in out]
    out += [("fr", "a b c d. a b c d! a b"), (None, "one two one two one two"), ("und", "One two"), ("de", None), ("de", ""), ("de", " .\n"), ("en", "a A a a a a a a")]
    return out + [("en", "the same line of words")] * 40


@pytest.mark.parametrize(("range_bytes", "ranked", "buffer", "read"), [(c.RANGE_BYTES, c.RANKED, c.BUFFER, c.READ), (300, 1, 50, 7)])
def test_matches_brute_force(spark, monkeypatch, range_bytes, ranked, buffer, read):
    monkeypatch.setattr(c, "SAMPLE_BYTES", 1 << 20)
    rows = texts()
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, score int").repartition(3)
    for least, top in ((3, 10), (2, 2000)):
        got = c.collocations(df, least=least, top=top, range_bytes=range_bytes, ranked=ranked)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top)


def drained(text, buffer, splits):
    """Blocks of a text as a task makes them, in this process."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    return [(r, b) for out in c._shards({"en": splits})([batch]) for r, b in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True)]


def test_buffers_and_ranges_lose_nothing(monkeypatch):
    text = " ".join(t for lang, t in texts() if lang == "en")
    want = drained(text, c.BUFFER, [])
    words, paths, counts = c.unpack(want[0][1])
    named = lambda ws, ps, cs: Counter({tuple(ws[i - 1] for i in p if i): int(n) for p, n in zip(ps, cs, strict=True)})
    whole = named(words, paths, counts)
    for buffer, read in ((40, 13), (17, 1 << 20)):
        monkeypatch.setattr(c, "BUFFER", buffer)
        monkeypatch.setattr(c, "READ", read)
        splits = [(b"a", b"", b"", b""), (b"a", b"b", b"bb", b""), (b"c", b"x", b"", b""), (b"zz", b"", b"", b"")]
        parts = drained(text, buffer, splits)
        total = Counter()
        for r, block in parts:
            found = named(*c.unpack(block))
            total += found
            for path in found:
                padded = (*path, *[b""] * (4 - len(path)))
                assert sum(s <= padded for s in splits) == r
        assert total == whole and len(parts) > 4


def test_transducer_round_trip():
    words = [b"a", b"b", b"c"]
    paths, counts = c._summed(c.np.array([[1, 2, 3, 1], [1, 2, 0, 0], [1, 2, 3, 1], [3, 0, 0, 0]], c.np.int32), c.np.array([1, 2, 10**12, 4]))
    got = c.unpack(c.pack(words, paths, counts))
    assert got[0] == words and (got[1] == paths).all() and got[2].tolist() == [2, 10**12 + 1, 4]


def test_large_counts_are_exact(spark, monkeypatch):
    """Products beyond 64 bits, with counts put in place of those of texts."""
    f = {"a": 9 * 10**15, "b": 7 * 10**15, "a b": 5 * 10**15 + 1, "c": 6 * 10**15, "a b c": 4 * 10**15, "b c": 4 * 10**15 + 3}
    rows = [("en", p, len(p.split()), n) for p, n in f.items()] + [("en", "", 0, 10**17)]
    monkeypatch.setattr(c, "phrase_counts", lambda *a: spark.createDataFrame(rows, "lang string, phrase string, k int, f bigint"))
    got = {r["phrase"]: (r["score"], r["l"], r["r"]) for r in c.collocations(spark.range(1)).collect()}
    assert got["a b c"] == min((2000000 * f["a b c"] // (x + y), x, y) for x, y in ((f["a"], f["b c"]), (f["a b"], f["c"])))
    assert got["a b"] == (2000000 * f["a b"] // (f["a"] + f["b"]), f["a"], f["b"]) and "b c" not in got


def test_empty(spark):
    assert c.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert c.collocations(spark.createDataFrame([("en", None), (None, "  ")], "lang string, text string")).count() == 0
