"""New lines snapped to reference water and freed of cycles, against a plain version."""

import random

from pyspark.sql import functions as F

from thalweg import catalog
from thalweg.operators import snapping
from thalweg.plans import basins

SF = "/root/testdata/sf0.001"


def plain(lines, reference):
    """place -> (dist, targets it may flow to) of one basin; lines of (x, y, elev, touches), reference of (id, x, y, elev)."""
    kept, starts = [], {}
    for line in lines:
        touched = [i for i, v in enumerate(line) if v[3]]
        if line[0][3] and line[-1][3]:
            continue
        kept.append(line)
        if touched:
            at = 0 if line[0][3] else len(line) - 1 if line[-1][3] else touched[0]
            x, y, e, _ = line[at]
            near = min(((x - a) ** 2 + (y - b) ** 2, i, a, b, h) for i, a, b, h in reference) if reference else None
            if near:
                starts[x, y] = max(0, near[4] - e), (near[2], near[3])
    steps = {}
    for line in kept:
        for (x, y, e, _), (a, b, f, _) in zip(line, line[1:]):
            steps.setdefault((x, y), {})[a, b] = max(0, e - f)
            steps.setdefault((a, b), {})[x, y] = max(0, f - e)
    if not starts:
        return {(x, y): None for line in kept for x, y, *_ in line}
    dist = {p: d for p, (d, _) in starts.items()}
    for _ in range(len(steps) + 1):
        for p in sorted(steps):
            for q, cost in steps[p].items():
                if p in dist and dist[p] + cost < dist.get(q, 1e99):
                    dist[q] = dist[p] + cost
    return {p: (d, {q for q in steps.get(p, ()) if q in dist and dist[q] + steps[q][p] == d} | ({starts[p][1]} if p in starts and starts[p][0] == d else set())) for p, d in dist.items()}


def test_forest_equals_a_plain_version(spark):
    rng = random.Random(7)
    rows, refs, want = [], [], {}
    for basin in range(9):
        height = {(x, y): rng.randint(0, 20) for x in range(9) for y in range(9)}
        water = {p for p in height if rng.random() < (0.15 if basin else 0)}
        lines = []
        for k in range(rng.randint(1, 8)):
            x, y, line = rng.randrange(9), rng.randrange(9), []
            for _ in range(rng.randint(1, 12)):
                line.append((x, y, height[x, y], (x, y) in water))
                x, y = min(8, max(0, x + rng.randint(-1, 1))), min(8, max(0, y + rng.randint(-1, 1)))
            lines.append(line)
        reference = [(100 * basin + i, rng.randint(-2, 11), rng.randint(-2, 11), rng.randint(0, 20)) for i in range(6)] if basin != 3 else []
        rows += [(basin, k, i, *v) for k, line in enumerate(lines) for i, v in enumerate(line)]
        refs += [(basin, *r) for r in reference]
        want[basin] = plain(lines, reference)
    vertices = spark.createDataFrame(rows, "basin_id long, line_id int, pos int, x int, y int, elev int, touches boolean").repartition(3)
    reference = spark.createDataFrame(refs, "basin_id long, vertex_id long, x int, y int, elev int")
    got = {}
    for r in snapping.forest(vertices, reference).collect():
        got.setdefault(r.basin_id, {})[r.x, r.y] = r
    assert sum(map(len, want.values())) > 100
    for basin, places in want.items():
        own = got.get(basin, {})
        assert set(own) == set(places)
        for p, known in places.items():
            r = own[p]
            if known is None:  # nothing snaps: lines as they run
                assert r.dist is None and not r.snapped
                continue
            assert r.dist == known[0] and (r.to_x, r.to_y) in known[1]
            seen, at = set(), r
            while not at.snapped:  # every place flows to reference water
                assert (at.x, at.y) not in seen
                seen.add((at.x, at.y))
                at = own[at.to_x, at.to_y]
    assert snapping.forest(vertices.limit(0), reference).count() == 0


def test_new_water_of_the_run_flows_to_reference_vertices(spark):
    cells = catalog.load(spark, SF, "b_cells_masked")
    thin = basins.cut(basins.cleaned(basins.connected(cells)), "thin")
    nodes = {}
    for r in basins.snapped_nodes(thin, catalog.reference(spark, SF)).collect():
        assert (r.basin_id, r.node_id) not in nodes
        nodes[r.basin_id, r.node_id] = r
    new = [r for r in nodes.values() if not r.from_ref]
    reached = 0
    for r in new:
        steps = 0
        while not r.from_ref and (r.basin_id, r.target_id) in nodes and steps < 2000:
            r, steps = nodes[r.basin_id, r.target_id], steps + 1
        reached += r.from_ref
    wet = {b for b, _ in ((r.basin_id, 0) for r in nodes.values() if r.from_ref)}
    assert new and reached >= 0.95 * sum(r.basin_id in wet for r in new)
    assert {r.node_id for r in new} <= {(r.r << 32) + r.c for r in thin.filter(F.col("kind") == 1).collect()}


def test_steps_that_lines_share_reach_the_kernel_once(spark, monkeypatch):
    """A hundred lines over the same places: the task of a basin gets each step once, and lines without touch keep the last one's course."""
    v = [(b, i, k, k + b, i % 2 * (k == 2), 9 - k, b == 0 and k == 0 and i < 99) for b in (0, 1) for i in range(100) for k in range(4)]
    vertices = spark.createDataFrame(v, "basin_id long, line_id long, pos int, x long, y long, elev long, touches boolean")
    ref = spark.createDataFrame([(0, i, -1, -1, 3) for i in range(50)], "basin_id long, vertex_id long, x long, y long, elev long")
    sizes, held = [], snapping.per_basin

    def counted(rows, *args):
        sizes.append(rows.count())
        return held(rows, *args)

    monkeypatch.setattr(snapping, "per_basin", counted)
    got = {(r.basin_id, r.x, r.y): (r.to_x, r.to_y, r.snapped) for r in snapping.forest(vertices, ref).collect()}
    assert sizes[0] < 20 and got[0, 0, 0] == (-1, -1, True) and got[1, 2, 0] == (3, 1, False) and got[1, 3, 1] == (4, 0, False)
