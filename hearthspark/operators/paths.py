"""Corrections at any path of nested documents, held as VARIANT.

A document is taken apart into its leaves (id, path, value): paths are dotted (``members.2.birth.place``), values are JSON text. Corrections come at any path; one at an inner
node brings an object or a list that is taken apart in the same way, so documents and corrections meet leaf by leaf. They do so in one aggregate by (id, path) that combines
in tasks, so a document with a third of all corrections spreads over tasks as well.

Cases: a null document or value at an inner node has the leaf ``null``; empty objects and lists are leaves; an id or index that no document has is a new one; a correction's null
overrides; of corrections of one path the latest wins, of equally late ones the greater JSON text; null paths are refused at level 1. A dot in a
field's name is read as a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A tree of known fields: None is a leaf, a dict an object, a list with one element a list of such.
Tree = dict | list | None


def depth(tree: Tree) -> int:
    """Levels below a node."""
    below = tree.values() if isinstance(tree, dict) else tree if isinstance(tree, list) else []
    return max((1 + depth(x) for x in below), default=0)


def leaves(rows: DataFrame, levels: int) -> DataFrame:
    """``rows`` (path, value: VARIANT, and others) with each object or list of ``value`` taken apart, down by ``levels`` levels at most; ``value`` is JSON text then."""
    others = [x for x in rows.columns if x not in ("path", "value")]
    out = rows.select(*others, "path", "value")
    for _ in range(levels):
        # Rows that are leaves by now go through as they are, so that ``rows`` is read and made once, not once for each level.
        text = F.to_json("value")
        inner = F.coalesce(text.rlike(r"^[\[{]") & ~text.isin("{}", "[]"), F.lit(False))
        whole = out.withColumn("_inner", inner).alias("w")
        parts = whole.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.when(F.col("w._inner"), F.col("w.value")).outer()).alias("p"))
        step = F.coalesce(F.col("p.key"), F.col("p.pos").cast("string"))
        path = F.when(~F.col("w._inner"), F.col("w.path")).when(F.col("w.path") == "", step).otherwise(F.concat("w.path", F.lit("."), step))
        out = parts.select(*[F.col(f"w.{x}") for x in others], path.alias("path"), F.when(F.col("w._inner"), F.col("p.value")).otherwise(F.col("w.value")).alias("value"))
    return out.select(*others, "path", F.coalesce(F.to_json("value"), F.lit("null")).alias("value"))


def refused_level(path: Column, tree: Tree) -> Column:
    """From which level on ``path`` is unknown to ``tree`` (1: its first step); one more than its steps if it ends at an inner node, null if it is a leaf's path."""
    steps = F.split(path, r"\.")

    def at(node: Tree, level: int) -> Column:
        step = F.get(steps, F.lit(level))
        if node is None:
            return F.when(step.isNotNull(), F.lit(level + 1))
        if isinstance(node, list):
            known = F.when(step.rlike(r"^(0|[1-9]\d{0,8})$"), at(node[0], level + 1))
            return known.otherwise(F.lit(level + 1))
        known = F.when(F.lit(False), F.lit(0))
        for name, below in node.items():
            known = known.when(step == name, at(below, level + 1))
        return known.otherwise(F.lit(level + 1))

    return at(tree, 0)


def taken_apart(corrections: DataFrame, tree: Tree) -> DataFrame:
    """``corrections`` (id, path, value: JSON text, at) as leaves, with ``level``: null if known, else the level that refuses it. Values that aren't JSON are strings."""
    text = F.try_variant_get(F.to_variant_object(F.array("value")), "$[0]", "variant")
    value = F.coalesce(F.try_parse_json("value"), text)
    found = leaves(corrections.select("id", "at", F.coalesce("path", F.lit("?")).alias("path"), value.alias("value")), depth(tree) + 1)
    return found.withColumn("level", refused_level(F.col("path"), tree))


def overlay(documents: DataFrame, corrections: DataFrame, tree: Tree) -> DataFrame:
    """Leaves (id, path, value) of ``documents`` (id, value: VARIANT) with ``corrections`` (see taken_apart) laid over them. Refused ones do nothing."""
    base = leaves(documents.select("id", F.lit("").alias("path"), "value"), depth(tree) + 1).select("id", "path", "value", F.lit(False).alias("new"), F.lit(None).alias("at"))
    fixes = taken_apart(corrections, tree).filter("level is null").select("id", "path", "value", F.lit(True).alias("new"), "at")
    last = F.max_by("value", F.struct("new", "at", "value"))
    return base.unionByName(fixes).groupBy("id", "path").agg(last.alias("value"))


def assembled(leaf_rows: DataFrame, tree: dict) -> DataFrame:
    """(id, value: VARIANT): documents from their leaves at paths that ``tree`` knows; lists hold the indices that have leaves, in order, fields without a leaf are null. One row holds one document."""
    known = leaf_rows.filter(refused_level(F.col("path"), tree).isNull())
    rows = known.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("_m"))

    def build(node: Tree, prefix: Column) -> Column:
        if node is None:
            return F.try_parse_json(F.get(F.filter(F.map_values(F.map_filter("_m", lambda k, v: k == prefix)), lambda v: v.isNotNull()), F.lit(0)))
        join = lambda step: F.concat(prefix, F.when(prefix == "", F.lit("")).otherwise(F.lit(".")), step)
        if isinstance(node, list):
            under = F.filter(F.map_keys("_m"), lambda k: k.startswith(F.concat(prefix, F.lit("."))))
            at = F.array_sort(F.array_distinct(F.transform(under, lambda k: F.get(F.split(F.substr(k, F.length(prefix) + 2), r"\."), F.lit(0)).cast("int"))))
            return F.transform(at, lambda i: build(node[0], join(i.cast("string"))))
        return F.struct(*[build(below, join(F.lit(name))).alias(name) for name, below in node.items()])

    return rows.select("id", F.to_variant_object(build(tree, F.lit(""))).alias("value"))
