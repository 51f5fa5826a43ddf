"""Bit-sliced top-k search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import bitsliced


def brute(rows, k):
    ok = [(i, n, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, m, v in ok:
        if q % 3 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, n, w in ok if n != m and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 70])
def test_top_k_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", block)
    monkeypatch.setattr(bitsliced, "CHUNK_QUERIES", 16)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5, -0.5, 0.25, 0.0, 0.1, 0.1]) for i in range(80)]  # a large group of ties
    rows += [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (405, []), (406, [1.0]), (407, [2.0]), (408, [-3.0]), (None, [0.1] * 6), (409, [0.0] * 6), (0, [0.3] * 6), (0, [0.3] * 6), (3, [9.0] * 6), (411, [300.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dims", F.lit("x")).repartition(3)
    got = sorted(map(tuple, bitsliced.top_k(df, F.col("vec_id") % 3 == 0).collect()))
    assert got == brute(rows, 5)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert bitsliced.top_k(df, F.lit(True)).count() == 0
    assert bitsliced.top_k(df.limit(0), F.lit(True)).count() == 0


def test_adders():
    rng = np.random.default_rng(1)
    grid = rng.integers(-100, 100, (130, 9))
    low, slices = bitsliced.slices_of(grid)
    query = rng.integers(-50, 50, 9)
    scores = bitsliced.add_slices(slices, query)
    bits = np.unpackbits(scores.view(np.uint8).reshape(len(scores), -1), axis=1, bitorder="little")[:, :130].astype(np.int64)
    full = (1 << slices.shape[1]) - 1
    base = np.where(query >= 0, query * low, query * (low + full)).sum()
    assert ((bits << np.arange(len(scores))[:, None]).sum(axis=0) + base == grid @ query).all()


def test_repeated_identifiers_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [0.5]), (2, [0.25])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") == 0, k=2, scale=4).collect())
    assert got == [(0, 1, 0, 32), (0, 1, 0, 32), (0, 2, 1, 8), (0, 2, 1, 16)]
