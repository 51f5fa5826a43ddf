"""Kernels over many whole groups at once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from thalweg.operators import lots, paths, tiled


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_lots_hold_whole_groups(spark, monkeypatch, most):
    monkeypatch.setattr(lots, "LOT", most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(None if g == 9 else g, i) for g in range(10) for i in range(g + 1)], "g long, i int").repartition(3)
        count = lambda part: pa.table({"g": part.column("g"), "n": pa.array(np.bincount(np.cumsum(lots.changes(part, ["g"])))[np.cumsum(lots.changes(part, ["g"]))])})
        got = {(r.g, r.n) for r in lots.by_lots(rows, ["g"], ["i"], count, "g long, n long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(None if g == 9 else g, g + 1) for g in range(10)}


def test_small_rows_are_dealt_to_all_tasks(spark):
    assert lots.dealt(spark.range(100), "id").rdd.getNumPartitions() == 4


@pytest.mark.parametrize(("seed", "cutoff", "descent"), [(1, 8.0, False), (2, 400.0, False), (3, 1e29, True)])
def test_cells_relaxed_together_come_as_near_as_one_by_one(seed, cutoff, descent):
    rng = random.Random(seed)
    place = [(r, c) for r in range(30) for c in range(30) if rng.random() < 0.8]
    r, c = (np.array(x) for x in zip(*place, strict=True))
    elev, weight = np.array([rng.randint(0, 30) for _ in place], float), np.array([rng.choice([0.0, rng.random() * 3]) for _ in place])
    sources = rng.sample(range(len(place)), 9)
    grid = paths.Grid(r, c, elev, weight)
    want, _ = grid.distances(sources, grid.descent if descent else grid.cost, cutoff)
    start = np.full(len(place), np.inf)
    start[sources] = 0
    got = tiled.relaxed(*tiled.step_costs(r, c, elev, weight, descent), start, np.array(sources), cutoff)
    assert got.tolist() == want.tolist() and np.isfinite(got).sum() > 20


def test_tiles_are_labelled_many_at_a_time(spark, monkeypatch):
    """Single tiles in calls of their own took most of the time: one call may hold many, and labels stay those of whole basins."""
    from thalweg.operators import components

    rng = random.Random(5)
    rows = [(b, r, c, rng.randint(0, 1), f"{r}") for b in (-4, 2) for r in range(-9, 9) for c in range(12)]
    cells = spark.createDataFrame(rows, "basin_id long, r int, c int, water int, _word string")
    at_once = []
    held = lambda rows, keys, order, run, schema: at_once.append((keys, schema)) or lots.by_lots(rows, keys, order, run, schema)
    monkeypatch.setattr(tiled, "by_lots", held)
    got = {(r.basin_id, r.r, r.c): (r.comp, r._word) for r in tiled.label(cells, tile=4).collect()}
    assert got == {(r.basin_id, r.r, r.c): (r.comp, r._word) for r in components.label(cells).collect()} and len(at_once) == 1


def test_cells_of_steps_are_looked_at_in_bounded_lots(spark, monkeypatch):
    """A vertical step of 1,000 cells, one of none and a slanted one, three cells at a time, in arrays and not in rows."""
    from thalweg.operators import spatial

    monkeypatch.setattr(spatial, "CELLS_AT_ONCE", 3)
    first, last = np.array([4, 1, -2]), np.array([5, 0, 3])
    got = list(spatial.unfolded(first, last))
    assert max(len(row) for row, _ in got) == 3
    assert [x for row, n in got for x in zip(row.tolist(), n.tolist(), strict=True)] == [(0, 4), (0, 5), *((2, n) for n in range(-2, 4))]
    ends = [np.array(x, float) for x in ((0.5, 0.5), (0.5, 0.5), (0.5, 2.5), (999.5, 2.5))]
    cells = sorted(x for a in spatial.cells_beside(*ends, 1.0, 0.0, 0.0, 0.0) for x in zip(*(k.tolist() for k in a), strict=True))
    corners = [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert cells == sorted([(0, 0, y) for y in range(1000)] + [(1, k, k) for k in range(3)] + [(1, *x) for x in corners])


def test_basins_are_converted_many_at_a_time(spark):
    """Kernels see whole basins; a null in one leaves the types of others alone, and one that fails takes no other with it."""
    from thalweg.operators.guard import Failures, each_basin, per_basin

    big = (1 << 60) + 1
    rows = spark.createDataFrame([(b, None if b == 3 and i == 0 else i, big + i) for b in range(6) for i in range(b + 1)], "basin_id long, i int, node long")
    run = lambda basin: basin.assign(n=len(basin), typed=basin["i"].dtype.kind == "i")
    plan = each_basin(rows, run, "basin_id long, i int, node long, n int, typed boolean")
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    got = plan.collect()
    assert len(got) == 21 and all(r.n == r.basin_id + 1 and r.typed == (r.basin_id != 3) for r in got)

    def fails(basin):
        return basin.assign(i=basin["i"] // (basin["basin_id"].iloc[0] != 4) if basin["basin_id"].iloc[0] != 4 else [][1])

    failures = Failures()
    left = per_basin(rows, fails, "basin_id long, i int, node long", failures, "kernel").collect()
    assert {r.basin_id for r in left} == {0, 1, 2, 3, 5} and {r.node for r in left if r.basin_id == 5} == {big + i for i in range(6)}
    assert [(r.basin_id, r.stage, r.error_kind) for r in failures.found(spark).collect()] == [(4, "kernel", "IndexError")]


def test_segments_are_linked_without_a_broadcast(spark):
    from thalweg import catalog

    assert "BroadcastHashJoin" not in catalog.segment_links(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_sources_are_mapped_without_a_broadcast(spark):
    from thalweg import catalog

    out = catalog.remap_sources(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().toString() and out.count() > 100
