import hashlib

from hearthspark.llm import warc
from hearthspark.llm.common import fresh_dir

PAGES = [
    (1, "http://www.A.example.com:80/x?q=1#f", "p" * 1500, "extra"), (2, "https://b.example.org/y", "p" * 1500, None), (9, "http://b.example.org/", "p" * 1500, ""), (3, "http://b.example.org/", "short", ""),
    (4, "http://b.example.org/", "short", ""), (5, None, None, ""), (6, "no scheme\nhere", "é" * 600, ""), (7, "http://x/%20a b", "é" * 600, ""), (None, "http://n/", "z" * 2000, ""), (8, "http://b.example.org/y", "q\r\n\r\nq", ""),
    (9, "http://b.example.org/other", "different" * 200, ""), (10, "http://u@h.example:8080", "", ""),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, type string")


def brute(rows):
    out = []
    for i, _, html, _ in rows:
        b = (html or "").encode()
        same = [j for j, _, h, _ in rows if (h or "").encode() == b and len(b) >= 1000 and j is not None]
        keeper = max(same) if same else None
        revisit = keeper is not None and i != keeper
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.digest(warc.archive(frame(spark, PAGES).repartition(3)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(PAGES)


def test_lookup_reads_single_blocks(spark):
    root = fresh_dir(spark, "test")
    rows = [(i, f"http://h{i % 7}.example.com/p/{i}", f"page {i} " * 300, "") for i in range(200)]
    directory = warc.write_archives(frame(spark, rows), root, block_lines=8)
    assert directory.count() >= 25
    wanted = [rows[5], rows[60], rows[199]]
    got = warc.lookup_urls(frame(spark, [*wanted, (0, "http://none.example.com/", "", "")]), root)
    assert sorted((r["id"], r["url"]) for r in got.collect()) == [(5, rows[5][1]), (60, rows[60][1]), (199, rows[199][1])]


def test_captures_of_a_hot_key_lie_in_many_blocks(spark):
    root = fresh_dir(spark, "test")
    rows = [(i, "http://hot.example.com/", f"page {i}", "") for i in range(300)] + [(900 + i, f"http://hot.example.com/{x}", "p", "") for i, x in enumerate("\x01 !a")]
    assert warc.write_archives(frame(spark, rows).repartition(4), root, block_lines=16).count() >= 19
    got = warc.lookup_urls(frame(spark, rows[:1]), root, task_bytes=1000)
    assert got.rdd.getNumPartitions() > 1 and sorted(r["id"] for r in got.collect()) == list(range(300))
    assert sorted(r["id"] for r in warc.lookup_urls(frame(spark, rows[300:]), root).collect()) == [900, 901, 902, 903]


def test_keys(spark):
    urls = [u for _, u, _, _ in PAGES if u] + ["HTTPS://Www.Example.COM", "http://h?x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["k"] for r in df.select("url", warc.key_column(df["url"]).alias("k")).collect()}
    assert got["http://www.A.example.com:80/x?q=1#f"] == "com,example,a,www)/x?q=1" and got["http://h?x"] == "h)/?x"
    assert all(got[u] == warc.surt(u) for u in urls if "\n" not in u)


def test_empty(spark):
    assert warc.digest(warc.archive(frame(spark, []))).count() == 0
