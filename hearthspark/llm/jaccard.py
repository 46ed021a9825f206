"""Near copies by exact Jaccard similarity of five-word shingles, for the corpus pipeline.

Two sets with similarity of at least SHARE share an element among the first n - ceil(SHARE n) + 1 of each (prefix filter), whatever order all sets are
held in. The order here puts shingles of often hit counters last, so common lines and passages stay out of the prefixes; the counters' number is fixed
and bears on speed only. A few counters see what large shares of a corpus have in common, but a shingle of some hundreds of documents is lost in their means, which grow with the corpus,
and such a shingle's pairs grow with its square. So prefixes are counted too, by Spark, on 2 ** 32 slots: shingles that more than CROWD prefixes hold go behind all others but those of the often hit counters,
and what enters the prefixes for them is counted in turn, until no more are found or PASSES have gone. Only slots of crowded shingles reach the driver, at most CROWDED.
Prefixes are shuffled by shingle, and those of one document alone are dropped as they stream by.

Candidates are pruned without loss, by lengths and places first, then by parity sketches: bit j is set if an odd number of a set's hashes fall on j, so the sketches of two sets differ in
at most as many bits as the sets in elements. A sketch has a 32nd to a 64th of its set's size. What remains is checked by the whole sets, so the rule is met exactly, up to
equal 64-bit hashes: a set is made where its text is read and sent once for each document it is compared with, to a tile that holds one document's set and as many others' as TILE elements allow.

Large groups of near copies don't meet pair by pair: while it finds any, a round compares each bucket's documents with its first one only, one first document each to begin with, and the
copies found leave. What remains is compared pair by pair, a hot shingle's documents in a grid of tiles. At the end no two documents left are near copies, and each that left is tied to one that stays
by a chain of near copies.

Cases: texts under five words are one shingle; null and empty texts have none and stay; repeated texts are near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspark.llm.common import SMALL, cut, fresh_dir, remove, spread_lookup, without
from hearthspark.llm.graph import components

SHINGLE = 5
#: Least similarity of near copies, in hundredths.
SHARE = 80
SEED = 43
COUNTERS = 1 << 16
#: Most elements of the sets that one tile compares with its own, and most documents of a shingle that are compared in one tile.
TILE, HOT = 2_000_000, 2_000
#: Most prefixes that a shingle enters in one pass before it goes to the end of the order, most slots of such shingles, and most passes.
CROWD, CROWDED, PASSES = 16, 1 << 20, 3
#: Ranks of shingles in the order: 0, then those of crowded slots by the bits of their number, then those of often hit counters.
OFTEN = 64


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hash_, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    hashes = [hash_(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)] or [hash_(joined, SEED)]
    return np.unique(np.array(hashes, np.uint64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for t in batch.column(0).to_pylist():
            np.add.at(total, (shingles(t) % np.uint64(COUNTERS)).astype(np.int64), 1)
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])


def levels(docs: DataFrame) -> np.ndarray:
    """Per counter, how many times (as a power of two) it is hit above the mean."""
    total = np.zeros(COUNTERS)
    for r in docs.select("text").mapInArrow(_count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["slot"]] = r["n"]
    return np.log2(np.maximum(total / max(total.mean(), 1), 1)).astype(np.int8)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


class Order(NamedTuple):
    """Levels of counters, and crowded slots (sorted) with their ranks."""

    level: np.ndarray
    slots: np.ndarray
    ranks: np.ndarray

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        often = self.level[(hashes % np.uint64(COUNTERS)).astype(np.int64)]
        if not len(self.slots):
            return np.where(often > 0, OFTEN + often, 0)
        slot = _slots(hashes)
        at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        return np.where(often > 0, OFTEN + often, np.where(self.slots[at] == slot, self.ranks[at], 0))


def _prefix(order: Order, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set, and its ranks."""
    rank, n = order.rank(found), len(found)
    first = np.lexsort((found, rank))[: n - -(-SHARE * n // 100) + 1]
    return found[first], rank[first]


def _entered(before: Order | None, now: Order, found: np.ndarray) -> np.ndarray:
    """Slots of a prefix's shingles of rank 0, without those that were in it before."""
    first, rank = _prefix(now, found)
    first = first[rank == 0]
    return _slots(first if before is None else np.setdiff1d(first, _prefix(before, found)[0], assume_unique=True))


def _crowds(shared: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [_entered(*shared.value, shingles(text)) for text in batch.column(0).to_pylist()]
            if slots:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots).view(np.int32))], names=["slot"])

    return rows


def ordered(docs: DataFrame, level: np.ndarray) -> Broadcast:
    """The order that prefixes are made by. It depends on the texts alone, not on how they are dealt out."""
    context, before, order = docs.sparkSession.sparkContext, None, Order(level, np.zeros(0, np.uint32), np.zeros(0, np.int8))
    for _ in range(PASSES):
        slots = docs.select("text").mapInArrow(_crowds(context.broadcast((before, order))), "slot int").groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
        crowded = cut(slots.filter(F.col("n") > CROWD).select("slot", F.length(F.bin("n")).alias("bits")))
        # The most crowded ones, as far as there is room, by whole powers of two.
        room, least = CROWDED - len(order.slots), None
        for bits, n in sorted(((r["bits"], r["count"]) for r in crowded.groupBy("bits").count().collect()), reverse=True):
            if n > room:
                break
            room, least = room - n, bits
        if least is None:
            break
        new = crowded.filter(F.col("bits") >= least).toArrow()
        slots = np.concatenate([order.slots, new["slot"].to_numpy().view(np.uint32)])
        ranks = np.concatenate([order.ranks, new["bits"].to_numpy().astype(np.int8)])
        at = np.argsort(slots)
        before, order = order, Order(level, slots[at], ranks[at])
    return context.broadcast(order)


def _prefixes(shared: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rids, sizes, places = [], [], [], []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingles(text)
                n = len(found)
                if n:
                    first, _ = _prefix(shared.value, found)
                    k = len(first)
                    keys.append(first.view(np.int64))
                    rids.append(np.full(k, rid))
                    sizes.append(np.full(k, n, np.int32))
                    places.append(np.arange(k, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, rids, sizes, places)], names=["key", "rid", "n", "at"])

    return rows


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key others have too. One row at most waits for the next batch."""
    waiting, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        same = np.concatenate([[last is not None and key[0] == last], key[1:] == key[:-1]])
        if waiting is not None and same[0]:
            yield waiting
        kept = same.copy()
        kept[:-1] |= same[1:]
        waiting = None if kept[-1] else batch.slice(batch.num_rows - 1)
        last = key[-1]
        yield batch.filter(pa.array(kept))


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of how many hashes fall on each of a power of two of bits, 64 at least and as many as hashes."""
    bits = 1 << max(6, (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many elements two sets differ at least, by their sketches; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def room(a: int, b: int) -> int:
    """In how many elements near copies of these sizes may differ."""
    return a + b - 2 * -(-SHARE * (a + b) // (100 + SHARE))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(map(sketch, sets), pa.binary())], names=["rid", "n", "sketch"])


def _like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches leave room for SHARE."""
    for batch in batches:
        n = batch.num_columns
        u, v, nu, nv, a, b = (batch.column(i).to_pylist() for i in range(n))
        kept = pa.array([apart(x, y) <= room(i, j) for i, j, x, y in zip(nu, nv, a, b, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3)], names=["u", "v", "nv"]).filter(kept)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingles(text).view(np.int64) for text in batch.column(3).to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], names=["u", "salt", "v", "set"])


def _tile(table: pa.Table) -> pa.Table:
    """Of a tile, one set and those to be compared with it, the near copies."""
    vs, sets = table.column("v").to_pylist(), [np.asarray(x.values) for x in table.column("set")]
    own = sets[vs.index(None)]
    found = []
    for v, other in zip(vs, sets, strict=True):
        if v is not None:
            both = len(own) + len(other) - len(np.union1d(own, other))
            if (100 + SHARE) * both >= SHARE * (len(own) + len(other)):
                found.append(v)
    u = table.column("u")[0].as_py()
    return pa.table([pa.array([u] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["u", "v"])


def _possible(a: str, b: str):
    """Lengths and places of a shared shingle leave room for SHARE: with |A and B| = o, 100 o >= SHARE (|A| + |B| - o)."""
    most = F.least(f"{a}.at", f"{b}.at") + 1 + F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at")) - 1
    return (100 + SHARE) * most >= SHARE * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts of ``asked`` (rid, ...; cut), which is broadcast if it is small, so that only texts that are asked for move."""
    return docs.select("rid", "text").join(F.broadcast(asked) if asked.count() * 64 <= SMALL else asked, "rid")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (u, v, nv; cut) whose whole sets are similar enough."""
    salts = F.ceil(F.col("_n") / TILE).cast("int")
    load = pairs.groupBy("u").agg(F.sum("nv").alias("_n")).select("u", salts.alias("salts"))
    dealt = pairs.join(load, "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))
    own = dealt.select("u", "salt").distinct().select(F.col("u").alias("rid"), "u", "salt", F.lit(None).cast("bigint").alias("v"))
    asked = cut(dealt.select(F.col("v").alias("rid"), "u", "salt", "v").unionByName(own))
    sets = _texts(docs, asked).select("u", "salt", "v", "text").mapInArrow(_sets, "u bigint, salt int, v bigint, set array<bigint>")
    return sets.groupBy("u", "salt").applyInArrow(_tile, "u bigint, v bigint")


def _checked(pairs: DataFrame, docs: DataFrame, one_is_enough: bool) -> DataFrame:
    """Near copies among pairs (u, v). If one link is enough for each v, others of a v that has one aren't looked at."""
    pairs = cut(pairs.distinct())
    ids = cut(pairs.select(F.col("u").alias("rid")).unionByName(pairs.select(F.col("v").alias("rid"))).distinct())
    sketches = cut(_texts(docs, ids).select("rid", "text").mapInArrow(_sketches, "rid bigint, n int, sketch binary"))
    side = lambda x: sketches.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    met = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "su", "sv")
    like = cut(met.mapInArrow(_like, "u bigint, v bigint, nv int"))
    if not one_is_enough:
        return _verified(like, docs)
    first = cut(_verified(cut(like.groupBy("v").agg(F.min("u").alias("u"), F.first("nv").alias("nv"))), docs))
    rest = cut(like.join(first.select("v"), "v", "left_anti"))
    return first.unionByName(_verified(rest, docs))


def _grid(left: DataFrame, tile: int) -> DataFrame:
    """Pairs (u, v), u < v, of documents with a shingle in common. A shingle of more than ``tile`` documents is compared in a grid of tiles, each row going to those of its line and column."""
    side = F.coalesce("_side", F.lit(1))
    hot = cut(left.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > tile).select("key", F.ceil(F.col("_n") / tile).cast("int").alias("_side")))
    marked = left.join(F.broadcast(hot) if hot.count() * 64 <= SMALL else hot, "key", "left").withColumn("_i", F.pmod(F.xxhash64("rid"), side).cast("int")).withColumn("_all", F.sequence(F.lit(0), side - 1))
    u = marked.select("key", "rid", "n", "at", F.col("_i").alias("_x"), F.explode("_all").alias("_y")).alias("u")
    v = marked.select("key", "rid", "n", "at", F.explode("_all").alias("_x"), F.col("_i").alias("_y")).alias("v")
    met = u.join(v, ["key", "_x", "_y"]).filter(F.col("u.rid") < F.col("v.rid")).filter(_possible("u", "v"))
    return met.select(F.col("u.rid").alias("u"), F.col("v.rid").alias("v"))


def near_copies(docs: DataFrame, tile: int = HOT) -> DataFrame:
    """``rid`` of the documents (rid: distinct bigint, text) that leave; of each group of near copies the least ``rid`` stays. ``docs`` should be cut or a table."""
    # As a table: checkpoints would take four times the room.
    spark, schema = docs.sparkSession, "key bigint, rid bigint, n int, at int"
    path = fresh_dir(spark, "jaccard")
    every = docs.select("rid", "text").mapInArrow(_prefixes(ordered(docs, levels(docs))), schema)
    every.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, schema).write.parquet(path)
    left = spark.read.schema(schema).parquet(path)
    gone = []
    while True:
        first = left.groupBy("key").agg(F.min_by(F.struct("rid", "n", "at"), "rid").alias("f"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        met = spread_lookup(left, cut(first), "key", "size", "rid", ["f"]).filter("f is not null").select(F.struct("rid", "n", "at").alias("v"), F.col("f").alias("u"))
        pairs = met.filter(F.col("u.rid") < F.col("v.rid")).filter(_possible("u", "v")).select(F.col("u.rid").alias("u"), F.col("v.rid").alias("v"))
        found = _left(_checked(pairs, docs, True))
        if found.isEmpty():
            break
        gone.append(found)
        left = cut(without(left, found, "rid"))
    gone.append(_left(_checked(_grid(left, tile), docs, False)))
    remove(spark, path)
    out = gone[0]
    for more in gone[1:]:
        out = out.unionByName(more)
    return out


def _left(links: DataFrame) -> DataFrame:
    return cut(components(links).select(F.col("node").alias("rid")))
