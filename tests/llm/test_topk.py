import math
import random

import pytest
from pyspark.sql import functions as F

from hearthspark.llm import topk


def brute(rows, k):
    """Every row is a query and a candidate of its own."""
    from fractions import Fraction

    good = [(i, tuple(math.floor(1024 * Fraction(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % 10 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(q, v, strict=True)), -(2**63)), 2**63 - 1), j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("tiles", [{}, {"tile_rows": 9, "fan": 2}])
def test_matches_brute_force(spark, tiles):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, rng.random()]) for _ in range(4)]) for i in range(120)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (210, [None, 1.0, 0.0, 0.0]), (220, [math.nan] * 4), (230, [math.inf, 0.0, 0.0, 0.0]), (240, []), (241, []), (250, [1e9, 1.0, -1e9, 2.0]), (251, [1e9, 1.0, 1e9, 2.0]), (260, [1.0] * 3), (None, [0.1] * 4)]
    rows += [rows[7], rows[10], rows[10], (20, [0.3] * 4), (270, [1e306, -1e306, 5e-324, 1.7e308]), (271, [1e306, 1e306, -5e-324, -1.7e308])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = topk.top_k(df, F.col("id") % 10 == 0, 5, **tiles)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_grid_shuffles_least():
    for q, n in ((10, 10**6), (10**4, 10**6), (10**7, 10**9)):
        r, c = topk.grid(q, n, 32768, 1)
        assert -(-q // r) + -(-n // c) <= 32768 + 2
        assert all(q * c2 + n * r2 >= 0.99 * (q * c + n * r) for r2, c2 in ((r * 2, -(-n // max(1, 32768 - -(-q // (r * 2))))), (max(1, r // 2), -(-n // max(1, 32768 - -(-q // max(1, r // 2)))))) if -(-q // r2) < 32768)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("id") % 10 == 0).count() == 0


def test_long_vectors_make_smaller_tiles(spark, monkeypatch):
    assert topk.rows_of_tile(64) == topk.TILE_ROWS and topk.rows_of_tile(4096) * 4096 * 8 <= topk.TILE_BYTES and topk.rows_of_tile(0) == topk.TILE_ROWS and topk.rows_of_tile(10**9) == 2
    monkeypatch.setattr(topk, "TILE_BYTES", 8 * 4 * 10)
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)]
    assert sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, 5).collect()) == brute(rows, 5)
