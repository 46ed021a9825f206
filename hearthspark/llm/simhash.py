"""Operator 2, SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay code
(23, 12, 7). A segment's keys are the indices of the codewords that it and its neighbours at one bit decode to: one index if it lies
within two bits of a codeword, else six. Two segments that differ in at most one bit share a key: the other segment's own decoding.
Three differing bits leave at least two segments with at most one each (pigeonhole), so each fingerprint is stored under its own indices
of the three pairs of segments, 24 bits each, and looks up all combinations of its keys, at most 108. The join checks the whole
distance, so its rows are links, each at most three times.

Fingerprints are classes: copies with one fingerprint are looked up once and meet their component's id in a join that survives
hot classes. Components are found in Spark; nothing but counts reaches the driver.

Cases: null and empty texts have fingerprint zero and are linked like any other; a null id is never the smallest (a component of null
ids has a null id); repeated rows each give a row; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspark.llm.common import cut, spread_lookup
from hearthspark.llm.graph import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Bits per segment, from the lowest.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Rows of keys that a task should make.
GROWN = 4_000_000
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits of the XXH64 of all word shingles of a UTF-8 text, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return 0
    hash_, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) < shingle:
        return hash_(joined, seed)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    count, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for i in range(0, n, _CHUNK):
        hashes = [hash_(joined[a:b], seed) for a, b in zip(starts[i : min(n, i + _CHUNK)], ends[i + shingle - 1 :], strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def fingerprints(texts: pd.Series) -> pd.Series:
    """Signed fingerprints of texts; null is empty."""
    found = [fingerprint(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
    return pd.Series(np.array(found, np.uint64).view(np.int64))


def _remainder(v: np.ndarray) -> np.ndarray:
    """23-bit words modulo the generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error pattern of each syndrome: all patterns of three bits at most."""
    errors = np.array([sum(1 << b for b in c) for n in range(4) for c in combinations(range(23), n)])
    pattern = np.zeros(1 << 11, np.int64)
    pattern[_remainder(errors)] = errors
    return _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12), pattern


def decode(v: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the one codeword within three bits of each 23-bit word."""
    low, high, pattern = _tables()
    return (v ^ pattern[low[v & 0xFFF] ^ high[v >> 12]]) >> 11


def segment_keys(v: np.ndarray) -> np.ndarray:
    """(n, 6): column 0 the own index, then those that neighbours decode to, -1 where there are none."""
    around = np.sort(decode(v[:, None] ^ (1 << np.arange(23))[None, :]), axis=1)
    own = decode(v)
    # 23 neighbours: all decode alike within two bits of a codeword, else three do and the other twenty meet five more codewords, four each.
    new = np.concatenate([np.ones((len(v), 1), bool), around[:, 1:] != around[:, :-1]], axis=1) & (around != own[:, None])
    out = np.full((len(v), 6), -1, np.int64)
    out[:, 0] = own
    rows, cols = np.nonzero(new)
    out[rows, 1 + (np.cumsum(new, axis=1) - 1)[rows, cols]] = around[rows, cols]
    return out


def pair_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unsigned fingerprints: (n, 3) keys to be stored under, (n, 108) keys to look up, -1 where there are none."""
    parts, at = [], 0
    for bits in SEGMENTS:
        parts.append(segment_keys((fps >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1)))
        at += bits
    stored, asked = [], []
    for n, (i, j) in enumerate(combinations(range(3), 2)):
        a, b = parts[i], parts[j]
        stored.append(n << 24 | a[:, 0] << 12 | b[:, 0])
        both = n << 24 | a[:, :, None] << 12 | b[:, None, :]
        asked.append(np.where((a[:, :, None] >= 0) & (b[:, None, :] >= 0), both, -1).reshape(len(fps), 36))
    return np.stack(stored, axis=1), np.concatenate(asked, axis=1)


def _emit(which: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 4096):
                part = fps[i : i + 4096]
                keys = pair_keys(part)[which]
                r, c = np.nonzero(keys >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(keys[r, c].astype(np.int32)), pa.array(part[r].view(np.int64))], names=["key", "fp"])

    return rows


def links(fps: DataFrame) -> DataFrame:
    """Pairs (u, v) of the distinct fingerprints in ``fp``, u < v, with at most DISTANCE differing bits; a pair may come up to three times."""
    fps = fps.select("fp")
    # Each row becomes up to 108, so they are dealt out by what they will be.
    fps = fps.repartition(max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() * 108 // GROWN + 1))
    asked = fps.mapInArrow(_emit(1), "key int, fp bigint").withColumnRenamed("fp", "u")
    stored = fps.mapInArrow(_emit(0), "key int, fp bigint").withColumnRenamed("fp", "v")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
    return asked.join(stored, (asked["key"] == stored["key"]) & near).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row_id``, ``id``, ``fp`` (signed 64 bits), ``component`` (the smallest id reachable)."""
    rows = docs.select(F.col(id_col).alias("id"), F.pandas_udf(fingerprints, "bigint")(F.col(text_col)).alias("fp"))
    rows = cut(rows.withColumn("row_id", F.monotonically_increasing_id()))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(classes))
    # A class without links is its own component.
    labelled = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    labelled = cut(labelled)
    owners = cut(labelled.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n_fps")))
    by_fp = cut(spread_lookup(labelled, owners, "root", "n_fps", "fp", ["component"]).select("fp", "n", "component"))
    return spread_lookup(rows, by_fp, "fp", "n", "row_id", ["component"])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
