import random
import re

import pytest

from hearthspark.llm import licenses
from hearthspark.llm.licenses import Template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(doc_id, text, known, k=3, step=8):
    """Every template at every place and every band of diagonals, word by word."""
    w, base, base_labels, labels, score = split(text), [], set(), set(), 0.0
    for t in known:
        x = split(t.text)
        if t.lack == 0:
            found = [i for i in range(len(w)) if w[i : i + len(x)] == x]
            share = float(bool(found))
            if t.base and found:
                base += found
                base_labels.add(t.label)
        else:
            best = 0
            hits = [(i - j, j) for i in range(len(w) - k + 1) for j in range(len(x) - k + 1) if w[i : i + k] == x[j : j + k]]
            for b in {d // step - o for d, _ in hits for o in (0, 1)}:
                best = max(best, len({p for d, j in hits if b * step <= d < (b + 2) * step for p in range(j, j + k)}))
            share = best / len(x) if best >= len(x) - t.lack else 0.0
        if share:
            labels.add(t.label)
            score = max(score, share)
    return doc_id, len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


KNOWN = [Template("p", "a b c", True), Template("q", "b c a b", True), Template("r", "c a b d"), Template("n", "a b c d e f a b c g h i j k l", lack=4), Template("m", "c b a c b a d d e", lack=2)]


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}])
def test_matches_brute_force(spark, options):
    rng = random.Random(3)
    texts = [None, "", "a", "A b", "a, b. c", "É a b c É", "a b c " * 400, "a b c a b " * 50]
    for _ in range(150):
        w = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(60))]
        at = rng.randrange(len(w) + 1)
        part = split(rng.choice(KNOWN).text)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(part))
            part[i : i + 1] = rng.choice([[], ["x"], [part[i], "y"], [part[i]]])
            part = part or ["z"]
        texts.append(" ".join(w[:at] + part + w[at:]))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b c", "x"), (7, "a b c d", "x"), (7, "a b c d", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = licenses.digest(licenses.scan_licenses(df, known=KNOWN, **options))
    want = sorted((brute(i, t, KNOWN) for i, t, _ in rows), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(bool(r[6]) for r in want) > 30 and any("m" in r[6].split(",") and r[7] < 1 for r in want)


def test_shipped_templates(spark):
    mit, isc = licenses.NOTICES["mit"], licenses.NOTICES["isc"]
    cut_up = " ".join(w for i, w in enumerate(mit.split()) if i % 40 != 20)
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3.", "no license at all", cut_up, isc, " ".join(mit.split()[:40])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan_licenses(df)).collect()}
    assert [got[i]["labels"] for i in range(8)] == ["mit", "apache-2", "cc-by-nc", "gpl-3", "", "mit", "isc", ""]
    assert [got[i]["base_labels"] for i in range(8)] == ["mit", "apache-2", "cc-by-nc", "", "", "", "", ""]
    assert got[0]["first_word"] == got[0]["last_word"] == 1 and 0.8 <= got[5]["score"] < 1 and got[4]["score"] == 0
    assert [got[i]["labels"] for i in range(8)] == [brute(i, t, licenses.templates())[6] for i, t in enumerate(texts)]


def test_hot_and_long_texts(spark):
    """A notice in every text, and one text that repeats a phrase very often."""
    rows = [(i, f"word{i} {licenses.NOTICES['mit']} Released under the MIT License") for i in range(300)] + [(1000, "under the mit license " * 30_000)]
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert len(got) == 301 and got[1000]["n_base"] == 30_000 and got[1000]["last_word"] == 4 * 29_999
    assert all(r["labels"] == "mit" and r["score"] == 1.0 for r in got.values())


def test_empty_tables_and_short_templates(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.digest(licenses.scan_licenses(empty)).count() == 0
    some = spark.createDataFrame([(1, "under the mit license")], "doc_id long, text string")
    assert [tuple(r) for r in licenses.digest(licenses.scan_licenses(some, known=[])).collect()] == [(1, 4, 0, None, None, "", "", 0.0)]
    with pytest.raises(ValueError, match="short"):
        licenses.scan_licenses(some, known=[Template("short", "a b")])
