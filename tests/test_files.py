"""Workbooks, archives and word tables: round trips, foreign and damaged files, limits."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from hearthspark.operators import household_text
from hearthspark.sources import archives, exports, parts, words, workbooks


@pytest.fixture()
def formats(spark):
    workbooks.register(spark)
    archives.register(spark)
    return spark


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def saved(df, kind, path, **options):
    df.write.format(kind).options(**options).mode("append").save(path)
    return df.sparkSession.read.format(kind).load(path)


def test_workbook_round_trip(formats, tmp_path):
    rng = random.Random(1)
    texts = [None, "", " ", "a<b>&\"'", "line\nline\ttab\rreturn", "_x0041_", "_x00_", "\x00\x01￿", "😀 é", "=1+1", "x" * workbooks.CELL_CHARS]
    data = [(rng.choice(texts), rng.choice(texts), str(i)) for i in range(60)]
    path = f"file://{tmp_path}/w"
    df = formats.createDataFrame(data, "a string, `b c` string, n string").repartition(3)
    back = saved(df, "workbooks", path, sheetRows=7)
    assert back.columns == ["a", "b c", "n"] and rows(back) == sorted(data, key=repr)
    files = [f for x in parts.commits(path) for f in x["files"]]
    assert len(files) > 8 and max(n for _, n in files) == 7 and sum(n for _, n in files) == 60
    assert back.rdd.getNumPartitions() == len(files)
    assert rows(back.select("n").filter("a is null")) == sorted(((n,) for a, _, n in data if a is None), key=repr)
    # A second write is added; files that no commit names are not read.
    (tmp_path / "w" / "part-lost.xlsx").write_bytes(b"half a file")
    assert saved(df, "workbooks", path).count() == 120


def test_workbook_is_what_the_single_writer_reads(formats, tmp_path):
    path = f"file://{tmp_path}/w"
    saved(formats.createDataFrame([("1", "x")], "n string, t string").coalesce(1), "workbooks", path)
    (name, _), = [f for x in parts.commits(path) for f in x["files"]]
    assert exports.read_xlsx(str(tmp_path / "w" / name)) == [["n", "t"], ["1", "x"]]


def test_workbook_limits(formats, tmp_path):
    path = f"file://{tmp_path}/w"
    empty = formats.createDataFrame([], "a string, b string")
    assert saved(empty, "workbooks", path).columns == ["a", "b"] and formats.read.format("workbooks").load(path).count() == 0
    for bad, message in ((formats.range(3), "text"), (formats.range(1).select(F.repeat(F.lit("x"), 40_000).alias("t")), "cell holds")):
        with pytest.raises(Exception, match=message):
            saved(bad, "workbooks", f"file://{tmp_path}/bad")
    assert parts.commits(f"file://{tmp_path}/bad") == [] and not list((tmp_path / "bad").glob("*.xlsx"))
    with pytest.raises(Exception, match="new folder"):
        empty.write.format("workbooks").mode("overwrite").save(path)
    with pytest.raises(Exception, match="no workbooks"):
        formats.read.format("workbooks").load(f"file://{tmp_path}/none")


def test_archive_round_trip(formats, tmp_path):
    data = [(f"f{i % 9}/{i}.bin", bytes([i % 256]) * (i * 37)) for i in range(80)] + [("twice", b"1"), ("twice", b"2"), ("empty", None)]
    path = f"file://{tmp_path}/a"
    back = saved(formats.createDataFrame(data, "name string, content binary").repartition(2), "archives", path, maxEntries=10, maxBytes=20_000)
    got = back.select("name", "content", "size", "error").collect()
    assert sorted((r["name"], bytes(r["content"])) for r in got) == sorted((n, b or b"") for n, b in data)
    assert all(r["error"] is None and r["size"] == len(r["content"]) for r in got)
    assert max(n for x in parts.commits(path) for _, n in x["files"]) <= 10
    listed = formats.read.format("archives").option("content", "false").load(path)
    assert listed.filter("content is not null").count() == 0 and listed.count() == len(data)
    for bad in ("/abs", "a/../b", "a\\b"):
        with pytest.raises(Exception, match="no name"):
            saved(formats.createDataFrame([(bad, b"")], "name string, content binary"), "archives", f"file://{tmp_path}/bad")


def test_foreign_archive(formats, tmp_path):
    """One archive with a folder, names that leave it, a large and a damaged entry; every other entry is read."""
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("folder/", "")
        for name, content in (("ok.txt", "fine"), ("../up", "u"), ("/abs", "a"), ("big", "b" * 500), ("hurt", "SPOILT-CONTENT"), ("last", "l")):
            z.writestr(name, content)
    path.write_bytes(path.read_bytes().replace(b"SPOILT-CONTENT", b"spoilt-content"))
    found = {r["name"]: r for r in formats.read.format("archives").option("maxEntryBytes", 100).load(f"file://{path}").collect()}
    assert set(found) == {"ok.txt", "../up", "/abs", "big", "hurt", "last"}
    assert [bytes(found[n]["content"]) for n in ("ok.txt", "last")] == [b"fine", b"l"]
    assert {n: found[n]["error"] for n in ("../up", "/abs", "big")} == {"../up": "parent folder", "/abs": "absolute path", "big": "entry too large"}
    assert found["hurt"]["content"] is None and found["hurt"]["error"].startswith("damaged")
    with pytest.raises(Exception, match="more than 3"):
        formats.read.format("archives").option("maxEntries", 3).load(f"file://{path}").count()
    summary = exports.archive_summary(formats.read.format("archives").option("content", "false").load(f"file://{path}"), ["ok.txt"]).first()
    assert (summary["file_count"], summary["ok"]) == (6, False)


def test_runs_cut_a_large_archive(formats, tmp_path, monkeypatch):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(9):
            z.writestr(str(i), "x" * 100)
    monkeypatch.setattr(archives, "_RUN_BYTES", 250)
    runs = archives._Reader(f"file://{path}", 100, 1000, True).partitions()
    assert [(r.first, r.last) for r in runs] == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 9)]


def test_word_tables(spark):
    head = "\t".join(words.COLUMNS)
    row = lambda level, line, word, conf, text: f"{level}\t1\t1\t1\t{line}\t{word}\t0\t0\t9\t9\t{conf}\t{text}"
    tsv = "\n".join([head, row(4, 1, 0, -1, ""), row(5, 1, 1, 90, "NAMA"), row(5, 1, 2, 0, "BUDI"), row(5, 1, 3, -1, "lost"), row(5, 2, 1, 60.5, " RT 1 "), "5\t1\t1\tshort", row(5, 2, 2, "?", "no"), row(5, 2, 3, 50, " "), row(5, 2, 4, 70, "more\tvalues"), ""])
    tables = spark.createDataFrame([(1, tsv), (2, None), (3, head), (4, row(5, 1, 1, 10, "CR\r") + "\r\n")], "id int, tsv string")
    texts = {r["id"]: tuple(r)[1:] for r in household_text.tsv_text(words.read_words(tables, "id"), "id").collect()}
    assert texts[1] == ("NAMA BUDI\nRT 1 more", 55.13, 4) and texts[3] == ("", 0.0, 0) and texts[4] == ("CR", 10.0, 1) and 2 not in texts
    counts = {r["id"]: tuple(r)[1:] for r in words.line_counts(tables, "id").collect()}
    assert counts == {1: (7, 2, 1), 2: (0, 0, 0), 3: (0, 1, 0), 4: (1, 0, 0)}
