"""Operator 8, exact top-k search by tiled matrix products.

Queries are dealt into R rows of tiles and all vectors into C columns; each query goes to the C tiles of its row and each vector to the R tiles of its
column. A tile of ``tile_rows`` rows shuffles least when it holds as many queries as vectors, or all queries if they are fewer, so R and C follow from the
two counts. A tile multiplies its two matrices in blocks and keeps each query's k best; lists of a query's tiles are merged ``fan`` at a time, then again,
as a tree, so no task ever holds more than fan * k rows of one query. Scores are integer inner products, exact: in double arithmetic where every sum stays
below 2**53, in whole numbers beyond it (a score outside the range of long stays at the nearest long).

Cases: vectors that are null or hold a null or non-finite component take no part; vectors of other lengths than the query's are no
candidates for it (an empty vector meets empty ones, with score zero); rows that repeat, or share an id, are queries and candidates of their own, and only a query's
own row is none of its candidates; ties go to the smaller id; components of any finite size are scaled without overflow; fewer candidates than k give all of them;
empty tables give empty results; null ids take no part; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspark.llm.common import cut

SCALE = 1024
K = 10
TILE_ROWS = 32768
#: Bytes of a tile's components as doubles; long vectors make tiles of fewer rows.
TILE_BYTES = 128 << 20
#: Vectors that are worth a task of their own.
LEAST_COLUMN = 2048
FAN = 16
_BLOCK = 256


def whole(rows: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component: doubles while these are exact, else Python's whole numbers."""
    if not rows.size or np.abs(rows).max() < 2.0**42:
        return np.floor(rows * scale)
    return np.array([[int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in r] for r in rows], object)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, (queries, rows) as int64."""
    if not q.shape[1]:
        return np.zeros((len(q), len(x)), np.int64)
    if q.dtype != object and x.dtype != object and np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    exact = lambda m: np.array([[int(v) for v in r] for r in m], object)
    top = 2**63 - 1
    return np.array([[min(max(v, -top - 1), top) for v in r] for r in exact(q) @ exact(x).T], np.int64)


def _tile(k: int, scale: int):
    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(x):
            x = x.sort_values(["vid", "vrid"], kind="stable")
            ids, rids, rows = x["vid"].to_numpy(np.int64), x["vrid"].to_numpy(np.int64), whole(np.stack(x["vvec"].to_numpy()).astype(np.float64), scale)
            for i in range(0, len(q), _BLOCK):
                part = q.iloc[i : i + _BLOCK]
                scores = products(whole(np.stack(part["vec"].to_numpy()).astype(np.float64), scale), rows)
                for qid, rid, s in zip(part["id"].to_numpy(np.int64), part["rid"].to_numpy(np.int64), scores, strict=True):
                    at = np.flatnonzero(rids != rid)
                    s = s[at]
                    if len(s) > k:  # all that reach the k-th best score; they stand in the order of ids
                        chosen = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        at, s = at[chosen], s[chosen]
                    order = np.argsort(~s, kind="stable")[:k]  # ~s is -s - 1: the order of falling scores, without overflow
                    out.append((np.full(len(order), rid), np.full(len(order), qid), ids[at][order], s[order]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        tile = q["tile"].iloc[0] if len(q) else 0
        return pd.DataFrame({"rid": cols[0], "query_id": cols[1], "vec_id": cols[2], "score": cols[3], "tile": np.full(len(cols[0]), tile, np.int32)})

    return best


def rows_of_tile(dim: int, tile_rows: int = TILE_ROWS) -> int:
    """Rows that a tile of vectors of that length may hold: at least two, a query and a row."""
    return max(2, min(tile_rows, TILE_BYTES // (8 * max(1, dim))))


def grid(queries: int, rows: int, tile_rows: int, tasks: int) -> tuple[int, int]:
    """(R, C): rows and columns of tiles, so that a tile holds at most about ``tile_rows`` rows of both kinds and least is shuffled; small tables make ``tasks`` columns."""
    side = max(1, min(queries, tile_rows // 2))
    r = max(1, -(-queries // side))
    return r, max(1, -(-rows // max(1, tile_rows - side)), min(-(-tasks // r), rows // LEAST_COLUMN))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, tile_rows: int = TILE_ROWS, fan: int = FAN) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's k best; ``is_query`` is a condition on ``id``."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad)).withColumn("dim", F.size("vec"))
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max("dim").alias("dim")).first()
    r, c = grid(counts["q"], counts["n"], rows_of_tile(counts["dim"] or 0, tile_rows), rows.sparkSession.sparkContext.defaultParallelism)
    asked = rows.filter(is_query).select("id", "rid", "dim", "vec", F.pmod(F.xxhash64("rid"), F.lit(r)).cast("int").alias("row"))
    asked = asked.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    given = rows.select(F.col("id").alias("vid"), F.col("rid").alias("vrid"), F.col("dim").alias("vdim"), F.col("vec").alias("vvec"), F.pmod(F.xxhash64("rid"), F.lit(c)).cast("int").alias("vtile"))
    given = given.withColumn("vrow", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    best = asked.groupBy("dim", "row", "tile").cogroup(given.groupBy("vdim", "vrow", "vtile")).applyInPandas(_tile(k, scale), "rid long, query_id long, vec_id long, score long, tile int")
    while True:
        last = c <= fan
        keys = ["rid", "query_id"] if last else ["rid", "query_id", "part"]
        best = best.withColumn("part", F.floor(F.col("tile") / fan).cast("int"))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
        if last:
            return best.select("query_id", "rank", "vec_id", "score")
        best, c = best.drop("rank", "tile").withColumnRenamed("part", "tile"), -(-c // fan)
