"""Operator 11, phrase collocation mining with weighted acyclic automata.

Every word of a piece starts a path of up to LONGEST words, and a phrase's count is the weight of all paths that begin with it, a prefix range of the sorted paths. Each task numbers its
words in the order of their bytes, sorts its paths and builds from the sorted runs, level by level, an acyclic count transducer: a state per distinct prefix, arcs with words,
weights at the ends, equal last arcs as one. Transducers are cut at prefix ranges that hold about equal shares of the paths, all tasks' cuts of one range meet in a task that
unions them and sums weights, and the phrases of at least ``least`` come out with their counts. A phrase whose paths cross the bounds of ranges lies on the first or last path of each
range it touches; these come out in parts whatever their weight and are summed. Phrases are then composed with their parts, both looked up in the same counts.

Ranges are cut where a sample of texts says (which bears on their sizes only, never on results), one for each RANGE_BYTES of text, MAX_RANGES at most. A task holds one buffer of
words and one transducer, a union one range's transducers. A word or passage that fills a third of all texts is one path of each task's transducer, and a frequent first word spreads over many ranges.

Cases: null texts are empty, a null lang is ``und``; a lang without words gives no rows; repeated rows count again; ties are broken by the phrase's bytes; very long texts are
read in pieces of READ bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspark.llm.common import cut, spread_lookup

LONGEST = 4
LEAST = 30
TOP = 2000
#: Longer candidates drop those they hold from this share (in hundredths) of their count.
INSIDE = 80
SCALE = 2_000_000
#: Words of a task's buffer, bytes of text read at once.
BUFFER, READ = 2_000_000, 1 << 20
RANGE_BYTES, MAX_RANGES = 8 << 20, 1 << 16
#: Of sampled texts (bytes for each range), one path in so many.
SAMPLE_BYTES, THIN = 64 << 10, 512
#: Most rows of a lang that one task ranks.
RANKED = 50_000

_BREAK = 0xFF  # no UTF-8 text has this byte
_SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", bytes([_BREAK]) * 10 + b" ")
Splits = dict[str, list[tuple[bytes, ...]]]


class _Numbered(dict):
    """Numbers words as they come; 0 is the break between pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Buffer:
    """The words of one lang that a task has read, numbered."""

    def __init__(self, carried: list[bytes] | None = None) -> None:
        self.ids = _Numbered({bytes([_BREAK]): 0})
        self.parts = [np.array([self.ids[w] for w in carried or []], np.int32)]
        self.size = len(self.parts[0])

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.array(list(map(self.ids.__getitem__, words)), np.int32))
        self.size += len(words)

    def drain(self, ended: bool) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
        """Words in the order of their bytes, distinct paths (rows of ranks from 1, 0 past the end) in order, their counts, and the words to carry on with, whose paths aren't complete."""
        tokens, names = np.concatenate(self.parts), list(self.ids)
        order = sorted(range(1, len(names)), key=names.__getitem__)
        rank = np.zeros(len(names), np.int32)
        rank[order] = np.arange(1, len(names))
        padded = np.concatenate([rank[tokens], np.zeros(LONGEST, np.int32)])
        n = len(tokens) if ended else max(len(tokens) - LONGEST + 1, 0)
        columns = [padded[:n].copy()]
        for d in range(1, LONGEST):
            columns.append(np.where(columns[-1] > 0, padded[d : n + d], 0))
        paths = np.stack(columns, axis=1)[columns[0] > 0]
        paths, counts = _summed(paths, np.ones(len(paths), np.int64))
        return [names[i] for i in order], paths, counts, [names[t] for t in tokens[n:]]


def _summed(paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their counts."""
    if not len(paths):
        return paths, counts
    wide = paths.astype(np.int64)
    high, low = wide[:, 0] << 32 | wide[:, 1], wide[:, 2] << 32 | wide[:, 3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return paths[order][first], np.add.reduceat(counts[order], first)


def starts(paths: np.ndarray) -> list[np.ndarray]:
    """Per depth, the rows of sorted ``paths`` at which another prefix of that depth begins."""
    new, out = np.zeros(len(paths), bool), []
    new[:1] = True
    for d in range(LONGEST):
        new = new.copy()
        new[1:] |= paths[1:, d] != paths[:-1, d]
        out.append(np.flatnonzero(new))
    return out


def pack(words: list[bytes], paths: np.ndarray, counts: np.ndarray) -> bytes:
    """The count transducer of sorted distinct paths: per level the arcs' words and the number of arcs of each state, and the last arcs with their weights, equal ones once."""
    used = np.unique(paths)
    used = used[used > 0]
    local = np.where(paths > 0, np.searchsorted(used, paths) + 1, 0).astype(np.uint32)
    at = starts(paths)
    labels = [local[at[d], d] for d in range(LONGEST - 1)]
    degrees = [np.diff(np.append(np.searchsorted(at[d + 1], at[d]), len(at[d + 1]))) for d in range(LONGEST - 1)]
    order = np.lexsort((counts, local[:, -1]))
    end_labels, end_counts = local[order, -1], counts[order]
    new = np.concatenate([[True], (end_labels[1:] != end_labels[:-1]) | (end_counts[1:] != end_counts[:-1])])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    arrays = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (*labels, *degrees, end_labels[new], end_counts[new], which)]
    data = pickle.dumps((b"\n".join(words[i - 1] for i in used), arrays), 5)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, paths and counts of a transducer."""
    joined, arrays = pickle.loads(pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True))
    labels, degrees, (end_labels, end_counts, which) = arrays[: LONGEST - 1], arrays[LONGEST - 1 : 2 * LONGEST - 2], arrays[2 * LONGEST - 2 :]
    columns: list[np.ndarray] = []
    for label, degree in zip(labels, degrees, strict=True):
        columns = [np.repeat(c, degree) for c in [*columns, label]]
    paths = np.stack([*(c.astype(np.int32) for c in columns), end_labels[which].astype(np.int32)], axis=1)
    return joined.split(b"\n") if joined else [], paths, end_counts[which].astype(np.int64)


def bounds(words: list[bytes], paths: np.ndarray, splits: list[tuple[bytes, ...]]) -> list[int]:
    """Where the ranges begin and end in ``paths``; a split's path belongs to the range it begins."""

    def place(word: bytes) -> int:
        if not word:
            return 0
        i = bisect_left(words, word)
        return 2 * i + 2 if i < len(words) and words[i] == word else 2 * i + 1

    found = [bisect_left(range(len(paths)), tuple(map(place, s)), key=lambda i: tuple(2 * int(r) for r in paths[i])) for s in splits]
    return [0, *found, len(paths)]


def _tokens(text: str) -> Iterator[list[bytes]]:
    """Words of a text with breaks between its pieces, a part at a time; the last part ends with a break."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_SPLIT).replace(bytes([_BREAK]), bytes([0x20, _BREAK, 0x20])) + bytes([0x20, _BREAK])
    at = 0
    while at < len(data):
        end = data.find(b" ", at + READ)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _shards(splits: Splits):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers: dict[str, _Buffer] = {}

        def drained(lang: str, ended: bool) -> pa.RecordBatch:
            words, paths, counts, carried = buffers[lang].drain(ended)
            buffers[lang] = _Buffer(carried)
            cuts = [(n, a, b) for n, (a, b) in enumerate(pairwise(bounds(words, paths, splits.get(lang, [])))) if a < b]
            blocks = [pack(words, paths[a:b], counts[a:b]) for _, a, b in cuts]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(cuts), pa.string()), pa.array([n for n, _, _ in cuts], pa.int32()), pa.array(blocks, pa.binary())], names=["lang", "range", "block"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                buffer = buffers.setdefault(lang, _Buffer())
                for part in _tokens(text.as_py()):
                    buffer.add(part)
                    if sum(b.size for b in buffers.values()) > BUFFER:
                        largest = max(buffers, key=lambda k: buffers[k].size)
                        yield drained(largest, largest != lang)
                        buffer = buffers[lang]
        for lang in buffers:
            yield drained(lang, True)

    return rows


def _union(least: int):
    def rows(table: pa.Table) -> pa.Table:
        """Frequent phrases of a range, and those on its first and last path, by length and weight; the weight of all, of length 0."""
        blocks = [unpack(b.as_py()) for b in table.column("block")]
        words = sorted(set().union(*(w for w, _, _ in blocks)))
        index = {w: i for i, w in enumerate(words, 1)}
        moved = [np.array([0, *map(index.__getitem__, w)], np.int32)[p] for w, p, _ in blocks]
        paths, counts = _summed(np.concatenate(moved), np.concatenate([c for _, _, c in blocks]))
        phrases, lengths, weights = [""], [0], [int(counts.sum())]
        for d, at in enumerate(starts(paths)):
            weight = np.add.reduceat(counts, at)
            kept = weight >= least
            kept[[0, -1]] = True
            kept &= paths[at, d] > 0
            for row in paths[at[kept], : d + 1]:
                phrases.append(b" ".join(words[i - 1] for i in row).decode("utf-8", "surrogatepass"))
                lengths.append(d + 1)
            weights += weight[kept].tolist()
        lang = pa.array([table.column("lang")[0].as_py()] * len(phrases), pa.string())
        return pa.table([lang, pa.array(phrases, pa.string()), pa.array(lengths, pa.int32()), pa.array(weights, pa.int64())], names=["lang", "phrase", "k", "f"])

    return rows


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = 0
    for batch in batches:
        langs, paths = [], []
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            for part in _tokens(text.as_py()):
                for i in range(-seen % THIN, len(part), THIN):
                    path = part[i : i + LONGEST]
                    path = path[: path.index(bytes([_BREAK]))] if bytes([_BREAK]) in path else path
                    if path:
                        langs.append(lang.as_py())
                        paths.append(path + [b""] * (LONGEST - len(path)))
                seen += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(paths, pa.list_(pa.binary()))], names=["lang", "path"])


def _splits(rows: DataFrame, range_bytes: int) -> Splits:
    """Bounds of about equal ranges, at most MAX_RANGES of them; some 20 sampled paths a range reach the driver."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(-(-size // range_bytes), MAX_RANGES)
    if n < 2:
        return {}
    some = rows.sample(min(1.0, n * SAMPLE_BYTES / size), seed=11).mapInArrow(_sampled, "lang string, path array<binary>")
    found = sorted((r["lang"], tuple(map(bytes, r["path"]))) for r in some.collect())
    out: dict[str, set[tuple[bytes, ...]]] = {}
    for i in range(1, n):
        if found:
            lang, path = found[i * len(found) // n]
            out.setdefault(lang, set()).add(path)
    return {lang: sorted(paths) for lang, paths in out.items()}


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``lang``, ``phrase`` (space-joined), ``k`` (words), ``f``: all phrases of up to LONGEST words with at least ``least`` occurrences; of length 0, the number of all words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = rows.mapInArrow(_shards(_splits(rows, range_bytes)), "lang string, range int, block binary")
    parts = blocks.groupBy("lang", "range").applyInArrow(_union(least), "lang string, phrase string, k int, f bigint")
    return parts.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("k") == 0))


def _key(phrase: Column) -> Column:
    """Lang and phrase in one; no word holds a tab."""
    return F.concat("lang", F.lit("\t"), phrase)


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def _best(rows: DataFrame, top: int, ranked: int) -> DataFrame:
    """Each lang's first ``top`` rows with their ``rank``; large langs are thinned out by salts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    share = max(ranked, 2 * top)  # rows of a salt, so each round leaves half of them at most
    while (n := rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) > share:
        salted = rows.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(n // share)))
        rows = cut(salted.withColumn("_p", place("lang", "_s")).filter(F.col("_p") <= top).drop("_p", "_s"))
    return rows.withColumn("rank", place("lang")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, inside: int = INSIDE, range_bytes: int = RANGE_BYTES, ranked: int = RANKED) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l``, ``r`` (of the parts at its lowest-scoring cut), ``n`` (words of the lang), ``score``."""
    counts = cut(phrase_counts(docs, lang_col, text_col, least, range_bytes))
    phrases = counts.filter("k > 0").withColumn("key", _key(F.col("phrase")))
    found = phrases.filter("k > 1").withColumn("w", F.split("phrase", " "))
    words = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    sides = F.array(F.struct(F.lit(True).alias("first"), _key(words(F.lit(1), F.col("at"))).alias("key")), F.struct(F.lit(False).alias("first"), _key(words(F.col("at") + 1, F.col("k") - F.col("at"))).alias("key")))
    asked = cut(cuts.select("lang", "phrase", "a", "at", F.explode(sides).alias("s")).select("lang", "phrase", "a", "at", "s.*"))
    weighted = cut(phrases.join(asked.groupBy("key").agg(F.count(F.lit(1)).alias("asked")), "key").select("key", "f", "asked"))
    side = lambda first: F.max(F.when(F.col("first") == first, F.col("f")))
    met = spread_lookup(asked, weighted, "key", "asked", "phrase", ["f"]).groupBy("lang", "phrase", "a", "at").agg(side(True).alias("l"), side(False).alias("r"))
    met = met.withColumn("score", F.try_divide(_wide("a") * SCALE - F.pmod(_wide("a") * SCALE, _wide("l") + _wide("r")), _wide("l") + _wide("r")).cast("bigint"))
    lowest = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.score", "m.l", "m.r")
    # Every part of at least two words of every longer candidate, with the largest count of those that hold it.
    held = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda at: words(at, n))))
    longer = found.filter("k > 2").select("lang", "f", F.explode(held).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * inside)).drop("longer")
    total = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return _best(cut(kept), top, ranked).join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
