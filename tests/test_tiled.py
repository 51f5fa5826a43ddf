"""Labels and distances tile by tile against the kernels that see a basin whole."""

import random

import pytest
from pyspark.sql import functions as F

from thalweg.operators import components, paths, tiled


def grid(spark, seed, n=23, share=0.55):
    rng = random.Random(seed)
    rows = [(b, r - 7, c - 5, rng.choices([1, 0, 2], [share, 0.9 - share, 0.1])[0], rng.randint(0, 30), rng.random() < 0.02, rng.random() * 2, "x", "y") for b in (3, 8) for r in range(n) for c in range(n) if rng.random() < 0.95]
    return spark.createDataFrame(rows, "basin_id long, r int, c int, water int, elev int, source boolean, weight double, node string, tr string").repartition(3)


@pytest.mark.parametrize(("seed", "tile", "share"), [(1, 4, 0.55), (2, 4, 0.42), (3, 7, 0.6), (4, 100, 0.5)])
def test_labels_by_tiles_equal_those_of_whole_basins(spark, seed, tile, share):
    cells = grid(spark, seed, share=share)
    got = {(r.basin_id, r.r, r.c): r.comp for r in tiled.label(cells, tile=tile).collect()}
    want = {(r.basin_id, r.r, r.c): r.comp for r in components.label(cells).collect()}
    assert got == want and max(want.values()) > 1 and min(want.values()) < -3


def test_a_river_that_winds_through_all_tiles_is_one(spark):
    rows = [(1, r, c, int(r % 2 == 0 or (c == 15 if r % 4 == 1 else c == 0))) for r in range(16) for c in range(16)]
    cells = spark.createDataFrame(rows, "basin_id long, r int, c int, water int")
    assert {r.comp for r in tiled.label(cells, tile=4).filter("water = 1").collect()} == {1}
    assert tiled.label(cells.limit(0), tile=4).count() == 0


@pytest.mark.parametrize(("cutoff", "descent"), [(8.0, False), (400.0, False), (1e29, True)])
def test_distances_by_tiles_equal_those_of_whole_basins(spark, cutoff, descent):
    nodes = grid(spark, 5).filter("water > 0")
    got = {(r.basin_id, r.r, r.c): r.dist for r in tiled.bounded_distances(nodes, cutoff, tile=4, descent=descent).collect()}
    if descent:
        want = {(r.basin_id, r.r, r.c): r.dist for r in paths.flow_forest(nodes).collect()}
    else:
        want = {(r.basin_id, r.r, r.c): r.dist for r in paths.bounded_distances(nodes, cutoff).collect()}
    assert got == want and len(got) > 100


def test_no_source_no_distance(spark):
    nodes = grid(spark, 6).withColumn("source", F.lit(False))
    assert tiled.bounded_distances(nodes, tile=4).count() == 0
