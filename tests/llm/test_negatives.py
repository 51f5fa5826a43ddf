"""Hard negatives by pivot tables against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives_=3, low=50, high=95):
    ok = [(i, n, [math.floor(256 * float(np.float32(x))) for x in v], (o + 1) % 10 if i % 7 == 0 else o) for n, (i, v, o) in enumerate(rows) if i is not None and o is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, m, v, o in ok:
        if a % 5:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), i, n, p) for i, n, w, p in ok if n != m and len(w) == len(v)]
        for s, i, _, _ in sorted(x for x in score if x[3] == o)[:positives]:
            fit = sorted(x for x in score if x[3] != o and -low * s <= -100 * x[0] <= -high * s)[:negatives_]
            out += [(a, i, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 5 == 0, label).collect()))


@pytest.mark.parametrize(("block", "run"), [(8192, 32), (60, 5)])
def test_mined_rows_equal_brute_force(spark, block, run, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "RUN", run)
    monkeypatch.setattr(negatives, "CHUNK_ANCHORS", 7)
    rng = random.Random(block)
    middle = [[rng.gauss(0, 0.5) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in middle[rng.randrange(6)]], rng.randrange(4)) for i in range(400)]
    rows += [(400 + i, [0.5, -0.5, 0.25, 0.0, 0.1, 0.1, 0.2, 0.2], i % 3) for i in range(90)]  # a group of ties
    rows += [(495, None, 1), (500, [None] * 8, 1), (505, [float("nan")] * 8, 1), (510, [float("inf")] * 8, 1), (515, [0.1] * 8, None), (None, [0.1] * 8, 1), (520, [], 1), (525, [], 1), (530, [], 2)]
    rows += [(535, [1.0], 1), (540, [2.0], 1), (541, [1.5], 2), (542, [-3.0], 2), (545, [0.0] * 8, 0), (0, [0.3] * 8, 0), (0, [0.3] * 8, 0), (550, [300.0] * 8, 1), (551, [200.0] * 8, 2), (555, [-0.2] * 8, -3), (560, [0.1] * 8, -3), (561, [0.09] * 8, 77)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS dims", "1 AS part", "2 AS row_no", "3 AS of").repartition(3)
    got = mined(df)
    assert got == brute(rows) and len(got) > 500


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**30 + 4 * i), float(i)], i % 2) for i in range(30)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert mined(df) == [] and mined(df.limit(0)) == []


def test_brackets_hold_and_leave_rows_out():
    """Bounds contain the scores, and in clustered data most rows are never scored."""
    rng = np.random.default_rng(13)
    grid = (rng.normal(size=(20, 16))[rng.integers(0, 20, 4000)] * 60 + rng.normal(size=(4000, 16)) * 4).astype(np.int64)
    square = (grid.astype(float) ** 2).sum(axis=1)
    bound = float(square.max())
    pivots = negatives.choose_pivots(grid[:500].tolist(), bound)
    table = negatives.pivot_distances(grid, np.sqrt(bound - square), pivots)
    order = np.lexsort((table.min(axis=0), table.argmin(axis=0)))
    row = {"n": 4000, "dims": 16, "bound": bound, "width": "<i8", "vectors": grid[order].tobytes(), "distances": table[:, order].astype(np.float32).tobytes()}
    block = negatives.Block(row | {k: np.zeros(4000, np.int64).tobytes() for k in ("ids", "numbers", "labels")})
    for a in range(0, 4000, 400):
        anchor = grid[order][a]
        near = negatives.pivot_distances(anchor[None], np.zeros(1), pivots)[:, 0]
        scores = grid[order] @ anchor
        rows, low, high = block.brackets(0, 4000, near, float(anchor @ anchor), -np.inf, np.inf)
        assert len(rows) == 4000 and (low <= scores[rows]).all() and (scores[rows] <= high).all()
        best = np.sort(scores)[-5]
        left = block.brackets(0, 4000, near, float(anchor @ anchor), best, np.inf)[0]
        assert set(np.flatnonzero(scores >= best)) <= set(left.tolist()) and len(left) < 2000
