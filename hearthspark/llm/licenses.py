"""Operator 12, license scans by diagonal voting.

Every run of K words of every text is hashed and joined to the positions of the same run in the license templates. A hit votes for its diagonal, the place in the text less the place
in the template: the words of a copy vote for one diagonal, those of a copy with words put in or left out for neighbouring ones. Votes are summed per text, template and
diagonal. Neighbouring diagonals are merged in bands that overlap by half, so any STEP + 1 neighbours share a band. A band whose votes could cover the template but for what its template may lack is
verified: its runs are compared word by word with the text, and the template words that they cover are counted.

Templates that may lack nothing are phrases; each of their places is a diagonal of its own, with all its runs verified. ``base`` templates give the base places.

Texts are scanned once and never shuffled whole, save those with candidate bands, whose words meet their bands once. Sums combine in tasks before the shuffle, by (text, template, diagonal),
so neither a license that a third of all texts carry nor a text that repeats one forms a group of its own. The templates' runs are broadcast up to BROADCAST_ROWS, else shuffled.

Cases: null and empty texts have no words and a score of 0; repeated rows and ids, null ids among them, each give a row; templates of fewer than K words
are refused; an empty table gives an empty result, no templates give no labels; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspark.llm.common import SMALL, cut, lower_ascii, numbered

K = 3
#: Bands start at every STEP-th diagonal and hold 2 * STEP of them.
STEP = 8
#: A copy of a notice may lack one in so many of its words; phrases may lack none.
LACK = 5
BROADCAST_ROWS = 100_000
#: What verification finds, per text.
VERIFIED = {"n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """A license text or phrase; ``lack`` words of it may be missing or changed."""

    label: str
    text: str
    base: bool = False
    lack: int = 0


# The contract's phrases and labels.
BASE = [
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
]
# Usual mentions of other licenses.
MENTIONS = [
    Template("agpl-3", "gnu affero general public license version 3"),
    Template("bsd", "under the bsd license"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("unlicense", "released into the public domain"),
]
# Notices that licenses ask to be kept, as their public texts have them.
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.""",
    "apache-2": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "gpl": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}


def word_list(text: str) -> list[str]:
    """What words() makes of a text, on the driver."""
    mark = "".join(c if not c.isascii() or c.isalnum() else " " for c in text)
    return mark.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ")


def templates() -> list[Template]:
    """The library's templates. A notice may lack a fifth of its words."""
    return [*BASE, *MENTIONS, *(Template(label, text, lack=sum(map(bool, word_list(text))) // LACK) for label, text in NOTICES.items())]


def words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and everything beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _hits(rows: DataFrame, runs: DataFrame, k: int, broadcast: bool) -> DataFrame:
    """(row, id, n_words, t, d): template and diagonal of each hit, and a row without template for each text."""
    # Columns that a lambda reads are read several times each, which keeps the optimizer from moving their making into the lambda.
    df = rows.withColumn("_h", F.transform(words(F.col("text")), lambda x: F.xxhash64(x))).withColumn("n_words", F.size("_h")).drop("text")
    run = F.transform(F.slice("_h", F.lit(1), F.greatest(F.col("n_words") - k + 1, F.lit(0))), lambda x, i: F.xxhash64(*[F.get("_h", i + j) for j in range(k)]))
    # Places start at -1, which keeps each text, hit or not. posexplode_outer: for posexplode() the optimizer would add a filter on the array's size and compute the array for it.
    df = df.select("row", "id", "n_words", F.posexplode_outer(F.concat(F.array(F.lit(None).cast("bigint")), run)).alias("p", "h"))
    key = F.col("h") if broadcast else F.coalesce("h", F.xxhash64("row"))  # marks are dealt out evenly
    met = df.join(F.broadcast(runs) if broadcast else runs, (key == F.col("rh")) & F.col("h").isNotNull(), "left")
    return met.filter(F.col("h").isNull() | F.col("rh").isNotNull()).select("row", "id", "n_words", "t", (F.col("p") - 1 - F.col("at")).alias("d"))


def _verified(given: list[tuple[list[str], int, bool, str]], k: int, step: int):
    """Of texts with their candidates (t, first diagonal): what holds word by word."""

    def places(w: list[str], template: list[str], starts: list[int]) -> list[int]:
        return [s for s in starts if w[s : s + len(template)] == template]

    def covered(w: list[str], template: list[str], first: int, runs: dict[tuple[str, ...], list[int]]) -> int:
        hit: set[int] = set()
        for p in range(max(first, 0), min(first + 2 * step - 1 + len(template), len(w)) - k + 1):
            for at in runs.get(tuple(w[p : p + k]), ()):
                if first <= p - at < first + 2 * step:
                    hit.update(range(at, at + k))
        return len(hit)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[dict[tuple[str, ...], list[int]]] = []
        for template, *_ in given:
            runs.append({})
            for at in range(len(template) - k + 1):
                runs[-1].setdefault(tuple(template[at : at + k]), []).append(at)
        for batch in batches:
            out = []
            for words_, bands in zip(batch.column(1), batch.column(2), strict=True):
                w, base, base_labels, labels, score = words_.as_py(), [], set(), set(), 0.0
                by_template: dict[int, list[int]] = {}
                for b in bands.as_py():
                    by_template.setdefault(b["t"], []).append(b["first"])
                for t, firsts in by_template.items():
                    template, lack, is_base, label = given[t]
                    if lack == 0:
                        found = places(w, template, firsts)
                        share = float(bool(found))
                        if is_base and found:
                            base += found
                            base_labels.add(label)
                    else:
                        best = max(covered(w, template, first, runs[t]) for first in firsts)
                        share = best / len(template) if best >= len(template) - lack else 0.0
                    if share:
                        labels.add(label)
                        score = max(score, share)
                out.append((len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))], names=["row", *VERIFIED])

    return check


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Template] | None = None, k: int = K, step: int = STEP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: ``row`` (its key), ``id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` (best share of a template that is covered)."""
    spark = docs.sparkSession
    given = [([w for w in word_list(t.text) if w], t.lack, t.base, t.label) for t in (templates() if known is None else known)]
    if short := [label for w, _, _, label in given if len(w) < k]:
        raise ValueError(f"templates of fewer than {k} words: {short}")
    flat = [(t, at, *w[at : at + k]) for t, (w, *_) in enumerate(given) for at in range(len(w) - k + 1)]
    names = [f"w{j}" for j in range(k)]
    runs = spark.createDataFrame(flat, ", ".join(["t int", "at int", *(f"{n} string" for n in names)])).select("t", "at", F.xxhash64(*[F.xxhash64(n) for n in names]).alias("rh"))
    facts = spark.createDataFrame([(t, len(w), lack) for t, (w, lack, *_) in enumerate(given)], "t int, size int, lack int")

    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "row")
    votes = _hits(rows, runs, k, len(flat) <= broadcast_rows).groupBy("row", "t", "d").agg(F.count(F.lit(1)).alias("votes"), F.first("id").alias("id"), F.first("n_words").alias("n_words"))
    votes = cut(votes)
    real = votes.filter("t is not null").select("row", "t", "d", "votes").join(F.broadcast(facts), "t")
    # A phrase's place has all its runs on one diagonal.
    exact = real.filter((F.col("lack") == 0) & (F.col("votes") >= F.col("size") - k + 1)).select("row", "t", F.col("d").cast("int").alias("first"))
    part = F.floor(F.col("d") / F.lit(step)).cast("int")
    bands = real.filter("lack > 0").select("row", "t", "size", "lack", "votes", F.explode(F.array(part - 1, part)).alias("b")).groupBy("row", "t", "b").agg(
        F.sum("votes").alias("votes"), F.first("size").alias("size"), F.first("lack").alias("lack"))
    # A run covers k words at most, so fewer votes than this can't cover enough.
    near = bands.filter(F.col("votes") * k >= F.col("size") - F.col("lack")).select("row", "t", (F.col("b") * step).alias("first"))
    asked = cut(exact.unionByName(near).groupBy("row").agg(F.collect_list(F.struct("t", "first")).alias("bands")))
    heavy = (asked.agg(F.sum(F.size("bands") * 16 + 64)).first()[0] or 0) > SMALL
    met = rows.select("row", "text").join(asked if heavy else F.broadcast(asked), "row").select("row", words(F.col("text")).alias("w"), "bands")
    kinds = ", ".join(f"{name} {kind}" for name, kind in VERIFIED.items())
    found = met.mapInArrow(_verified(given, k, step), f"row {met.schema['row'].dataType.simpleString()}, {kinds}")
    every = votes.filter("t is null").select("row", "id", F.col("n_words").cast("long").alias("n_words"))
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return every.join(found, "row", "left").select("row", "id", "n_words", *[F.coalesce(c, F.lit(none[c])).alias(c) if c in none else c for c in VERIFIED])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(F.col("id").alias("doc_id"), "n_words", F.col("n_base").cast("long").alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score")
