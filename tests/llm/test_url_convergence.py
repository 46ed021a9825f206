from collections import defaultdict

import pytest

from hearthspark.llm import queries
from hearthspark.llm import urlfilter as u
from tests.llm.test_urlfilter import rule_of, split


def chain(names):
    return list(zip(names, names[1:], strict=False))


#: x is eight links after a trusted seed and one before a blocked one; y is nine links before each of two blocked seeds; p and q link to each other.
EDGES = [
    *chain(["t.org", *[f"a{i}.net" for i in range(7)], "x.net", "bad.com"]),
    *chain(["y.net", *[f"b{i}.net" for i in range(8)], "worse.com"]), *chain(["y.net", *[f"c{i}.net" for i in range(8)], "worst.com"]),
    ("p.net", "q.net"), ("q.net", "p.net"), ("p.net", "a0.net"),
]
HOSTS = sorted({h for e in EDGES for h in e})


def pages():
    return [(i, f"http://{h}/{'de/' if h.endswith('.com') else ''}", "".join(f'<a href="http://{b}/">' for a, b in EDGES if a == h)) for i, h in enumerate(HOSTS)]


def brute():
    """Converged trust and distrust as shares of one."""
    out = {}
    for kind in (1, 0):
        ways = EDGES if kind else [(b, a) for a, b in EDGES]
        deg = defaultdict(int)
        for a, _ in ways:
            deg[a] += 1
        seed = {h: float((r := rule_of(*split(url))) is not None and (r[2] == "allow") == bool(kind)) for h, (_, url, _) in zip(HOSTS, pages(), strict=True)}
        rank = {h: 0.15 * s for h, s in seed.items()}
        for _ in range(500):
            flow = defaultdict(float)
            for a, b in ways:
                flow[b] += rank[a] / deg[a]
            rank = {h: 0.85 * flow[h] + 0.15 * seed[h] for h in HOSTS}
        out[kind] = rank
    return out


def test_query_follows_long_chains(spark, tmp_path):
    spark.createDataFrame(pages(), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["host"]: r for r in queries.op5_url_filters(spark, str(tmp_path)).collect()}
    want = brute()
    for h in HOSTS:
        assert abs(got[h]["trust"] / u.SCALE - want[1][h]) < 1e-4 and abs(got[h]["distrust"] / u.SCALE - want[0][h]) < 1e-4, h
    assert got["x.net"]["verdict"] == got["y.net"]["verdict"] == "block"


def test_unsettled_ranks_raise(spark, monkeypatch):
    monkeypatch.setattr(u, "MOST_ROUNDS", 4)
    with pytest.raises(RuntimeError):
        u.judge(spark.createDataFrame(pages(), "page_id long, url string, html string"))
