"""Corrections at any path against a plain merge of nested values."""

import json
import random

from pyspark.sql import functions as F

from hearthspark.operators import paths

TREE = {"kk": None, "address": {"street": None}, "members": [{"nama": None, "birth": {"place": None, "year": None}}]}
DOC, FIX = "id bigint, value string", "id bigint, path string, value string, at bigint"


def documents(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumn("value", F.parse_json("value"))


def flat(value, path=""):
    if isinstance(value, dict | list) and value:
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from flat(v, f"{path}.{k}" if path else str(k))
    else:
        yield path, value


def level(path):
    node = TREE
    for n, step in enumerate(path.split("."), 1):
        if isinstance(node, list) and step.isdigit() and (step == "0" or step[0] != "0"):
            node = node[0]
        elif isinstance(node, dict) and step in node:
            node = node[step]
        else:
            return n
    return None if node is None else len(path.split(".")) + 1


def test_against_plain_merge(spark):
    rng = random.Random(3)
    docs = [(i, json.dumps({"kk": str(i), "address": {"street": "A"}, "members": [{"nama": f"N{j}", "birth": {"place": "P", "year": 1990 + j}} for j in range(rng.randrange(4))]})) for i in range(8)]
    asked = ["kk", "address.street", "address", "members.0.nama", "members.1.birth", "members.5.birth.year", "members.01.nama", "members", "other.x", "members.2.birth.place.code", "kk.x"]
    values = ['"x"', "7", "null", '{"place": "Q", "year": 3}', '{"street": "B", "no": 4}', '[{"nama": "L"}, {"birth": {"place": null}}]', "{}", "not json"]
    fixes = [(rng.randrange(10), rng.choice(asked), rng.choice(values), at) for at in range(400)]
    want, refused = {(i, p): v for i, t in docs for p, v in flat(json.loads(t))}, set()
    for i, p, text, at in fixes:
        for q, v in flat("not json" if text == "not json" else json.loads(text), p):
            if level(q) is None:
                want[i, q] = v
            else:
                refused.add((i, at, q, level(q)))
    frame = spark.createDataFrame(fixes, FIX)
    got = paths.overlay(documents(spark, docs), frame, TREE).collect()
    assert len(got) == len(want) and {(r["id"], r["path"]): json.loads(r["value"]) for r in got} == want
    seen = paths.taken_apart(frame, TREE).filter("level is not null").select("id", "at", "path", "level").collect()
    assert {tuple(r) for r in seen} == refused


def test_assembled(spark):
    base = documents(spark, [(1, '{"kk": "1", "address": {"street": "A"}, "members": [{"nama": "N0", "birth": {"place": "P", "year": 1}}]}')])
    fixes = spark.createDataFrame([(1, "members.11.nama", '"late"', 1), (1, "members.3.birth", '{"place": "Q"}', 1), (1, "kk", "null", 1), (2, "kk", '"2"', 1)], FIX)
    out = paths.assembled(paths.overlay(base, fixes, TREE), TREE).select("id", F.to_json("value").alias("v")).collect()
    found = {r["id"]: json.loads(r["v"]) for r in out}
    blank = {"place": None, "year": None}
    assert found[1] == {"kk": None, "address": {"street": "A"}, "members": [{"nama": "N0", "birth": {"place": "P", "year": 1}}, {"nama": None, "birth": {"place": "Q", "year": None}}, {"nama": "late", "birth": blank}]}
    assert found[2] == {"kk": "2", "address": {"street": None}, "members": []}


def test_nulls_ties_and_empty_tables(spark):
    base = documents(spark, [(1, None), (2, "{}"), (3, '{"kk": "3", "extra": [1, {}]}')])
    fixes = spark.createDataFrame([(3, "kk", '"a"', 5), (3, "kk", '"b"', 5), (3, None, '"c"', 6), (3, "address.street", None, 7)], FIX)
    got = {(r["id"], r["path"]): r["value"] for r in paths.overlay(base, fixes, TREE).collect()}
    assert got == {(1, ""): "null", (2, ""): "{}", (3, "kk"): '"b"', (3, "extra.0"): "1", (3, "extra.1"): "{}", (3, "address.street"): "null"}
    assert [r["level"] for r in paths.taken_apart(fixes, TREE).filter("level is not null").collect()] == [1]
    assert paths.overlay(documents(spark, []), spark.createDataFrame([], FIX), TREE).count() == 0


def test_one_aggregate_without_python(spark):
    base = documents(spark, [(1, '{"kk": "1"}')])
    plan = paths.overlay(base, spark.createDataFrame([(1, "kk", '"2"', 1)], FIX), TREE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_rows_are_read_once(spark):
    """Whatever the levels, the plan reads its rows in one place; leaves of all levels come out."""
    rows = spark.range(3).selectExpr("id", "'' as path", """parse_json('{"a":{"b":[1,{"c":null}],"d":{}},"e":"x","f":[]}') as value""")
    found = paths.leaves(rows, 4)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    got = sorted((r["path"], r["value"]) for r in found.collect() if r["id"] == 1)
    assert got == [("a.b.0", "1"), ("a.b.1.c", "null"), ("a.d", "{}"), ("e", '"x"'), ("f", "[]")]
