"""Sources, entries and geometry by small examples."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from thalweg import catalog
from thalweg.functions import geometry
from thalweg.operators import lines, merge, network, spatial
from thalweg.plans import basins
from thalweg.sources import tables

SF = "/root/testdata/sf0.001"


def test_regions_and_masked_scans(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    shape = lambda i, kind, c: {"type": "Feature", "properties": {"HYBAS_ID": i, "x": 1}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "r.json").write_text(json.dumps({"type": "FeatureCollection", "features": [shape(7, "Polygon", [square]), shape(8, "MultiPolygon", [[square], [[[9, 9], [10, 9], [10, 10], [9, 9]]]])]}))
    regions = tables.scan_regions(spark, str(tmp_path / "r.json"))
    assert sorted((r.region_id, len(r.ring)) for r in regions.collect()) == [(7, 5), (8, 4), (8, 5)]
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in square])
    own = [(1, [(1.0, 1.0), (9.0, 9.0)]), (2, [(-1.0, 2.0), (5.0, 2.0)]), (3, [(5.0, 5.0), (6.0, 6.0)]), (4, [(1.0, 1.0), (1.0, 1.0)]), (5, [(-1.0, 6.0), (6.0, 4.5)])]
    spark.createDataFrame(own, "line_id long, line array<struct<x:double,y:double>>").write.parquet(str(tmp_path / "l"))
    found = spatial.meeting(tables.scan_lines(spark, str(tmp_path / "l"), ["line_id", "line"], F.col("line_id") < 9), ring)
    assert sorted(r.line_id for r in found.collect()) == [1, 2]


def test_index_is_kept_until_the_folder_changes(spark, tmp_path):
    folder = tmp_path / "tiles"
    folder.mkdir()
    for n in ("a_0_0_1_1.tif", "a_1_0_2_1.tif"):
        (folder / n).write_bytes(b"x")
    get = lambda: tables.kept_index(spark, str(folder), str(tmp_path / "index"))
    assert get().count() == 2 and get().count() == 2
    (folder / "a_2_0_3_1.tif").write_bytes(b"x")
    assert sorted(r.w for r in get().collect()) == [0, 1, 2]


def test_boxes_of_doubles_and_thin_slices(spark):
    rows = [(1, r, c, 5.0 if r else 2e30) for r in range(3) for c in range(3)] + [(2, 1, c, 7.0) for c in range(5)]
    got = {(x.r, x.c): x.v for x in tables.box_raster(spark.createDataFrame(rows, "tile int, r int, c int, v double"), "tile", "v", (0, 1, 1, 3)).collect()}
    assert got[1, 1] == got[1, 2] == 5.0 and all(got[k] != got[k] for k in [(0, 1), (0, 2), (0, 3), (1, 3)])


def test_broken_files_are_named(spark, tmp_path):
    tables.write_segments(spark.createDataFrame([(1, 7)], "region_id int, x int"), str(tmp_path / "t"))
    good = next((tmp_path / "t" / "region_id=1").glob("*.parquet")).read_bytes()
    bad = {"bad": b"not a table at all", "short": good[:-9], "footer": good[:-40] + b"\xff" * 32 + good[-8:], "page": good[:4] + b"\xff" * 24 + good[28:]}
    for name, data in bad.items():
        (tmp_path / "t" / "region_id=1" / f"part-{name}.parquet").write_bytes(data)
    spark.createDataFrame([], "x int").coalesce(1).write.parquet(str(tmp_path / "empty"))
    empty = next((tmp_path / "empty").glob("*.parquet"), None)
    if empty is not None:  # a table without rows is not broken
        (tmp_path / "t" / "region_id=1" / "part-empty.parquet").write_bytes(empty.read_bytes())
    assert [r.x for r in tables.read_segments(spark, str(tmp_path / "t"), str(tmp_path / "q")).collect()] == [7]
    named = sorted(r.file_name.rsplit("part-", 1)[1] for r in spark.read.parquet(str(tmp_path / "q")).collect())
    assert {"bad.parquet", "page.parquet", "short.parquet"} <= set(named) <= {f"{x}.parquet" for x in bad}
    assert tables.broken_files(spark, str(tmp_path / "empty")).count() == 0
    tables.write_network(spark.createDataFrame([(2,), (1,)], "stream_id long"), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2


def test_cells_near_a_step(spark):
    steps = spark.createDataFrame([(0.5, 0.5, 2.5, 0.5)], "x1 double, y1 double, x2 double, y2 double")
    assert sorted(map(tuple, spatial.touched_cells(steps, 1.0, 0.0).collect())) == [(0, 0), (1, 0), (2, 0)]
    assert sorted(map(tuple, spatial.touched_cells(steps, 1.0, 0.5).collect())) == sorted([(x, 0) for x in range(-1, 4)] + [(x, y) for x in range(3) for y in (-1, 1)])
    dot = spark.createDataFrame([(0.9, 0.5, 0.9, 0.5)], "x1 double, y1 double, x2 double, y2 double")
    assert sorted(map(tuple, spatial.touched_cells(dot, 1.0, 0.2).collect())) == [(0, 0), (1, 0)]


def test_nearest_vertices_of_clusters(spark):
    rng = random.Random(1)
    pts = [(i, i % 3, rng.randrange(1000), rng.randrange(1000)) for i in range(200)] + [(900, 7, 1, 1)]
    ref = [(i, i % 3, 500 + rng.randrange(4), 500 + rng.randrange(4)) for i in range(150)] + [(999, 0, 0, 0)]
    got = sorted(map(tuple, lines.nearest_vertices(spark.createDataFrame(pts, "point_id long, grp long, x long, y long"), spark.createDataFrame(ref, "vertex_id long, grp long, x long, y long")).collect()))
    want = []
    for p, g, x, y in pts:
        d = {v: (x - a) ** 2 + (y - b) ** 2 for v, h, a, b in ref if h == g}
        want += [(g, p, v, e) for v, e in d.items() if e == min(d.values())]
    assert got == sorted(want)


@pytest.mark.parametrize(("block", "lot"), [(1, 20_000), (2, 30), (3, 1), (10, 100)])
def test_orders_of_deep_trees(spark, block, lot, monkeypatch):
    """One system of 300 streams, deep and bushy, with a cycle beside it, against a plain recursion; bands alone and together."""
    monkeypatch.setattr(merge, "LOT_ROWS", lot)
    rng = random.Random(block)
    kids: dict[int, list[int]] = {0: []}
    for i in range(1, 300):
        p = i - 1 if i < 60 else rng.choice([k for k in kids if len(kids[k]) < 2])
        kids[p].append(i)
        kids[i] = []
    rows = [(i, *([*k, 7777][:2] if k else (-1, -1)), 1 + rng.randrange(3), 0) for i, k in kids.items()] + [(500, 501, -1, 2, 501), (501, 500, 400, 3, 500), (400, -1, -1, 1, 501)]
    df = spark.createDataFrame(rows, "stream_id long, us1 long, us2 long, base_order int, target_id long")
    base = {r[0]: r[3] for r in rows}

    def plain(i):
        known = [plain(k) for k in kids[i]]
        return merge.repaired(base[i], known, 2 if kids[i] else 0)

    got = {r.stream_id: r.x for r in merge.by_blocks(df, merge.repaired, "x", block).collect()}
    assert got == {i: plain(i) for i in kids} | {500: 2, 501: 3, 400: 1}


def test_lines_of_the_network_and_no_failures(spark, tmp_path):
    out = basins.vector_network(*inputs(spark), quarantine=str(tmp_path / "q")).collect()
    assert spark.read.parquet(str(tmp_path / "q")).count() == 0
    assert {r.line is None for r in out} == {True, False} and all(bytes(r.line[:5]) == b"\x01\x02\x00\x00\x00" for r in out if r.line)


def inputs(spark):
    return catalog.load(spark, SF, "b_cells_masked"), catalog.load(spark, SF, "b_streams"), catalog.reference(spark, SF)


def test_region_network_is_that_of_its_basins(spark):
    """A polygon takes the basins that meet it; what comes out is the network of these alone."""
    cells, streams, flow = inputs(spark)
    ids = sorted(r.basin_id for r in cells.select("basin_id").distinct().collect())
    places = spark.createDataFrame([(b, [(float(10 * b), 1.0), (float(10 * b), 3.0)]) for b in ids], "basin_id long, line array<struct<x:double,y:double>>")
    wanted = ids[: len(ids) // 2]
    ring = tables.ring_literal([(-5.0, 0.0), (10.0 * wanted[-1] + 5, 0.0), (10.0 * wanted[-1] + 5, 2.0), (-5.0, 2.0), (-5.0, 0.0)])
    own = F.col("basin_id").isin(wanted)
    got = basins.region_network(cells, streams, flow, places, ring).orderBy("stream_id").collect()
    want = basins.vector_network(cells.filter(own), streams.filter(F.col("stream_id").isin(wanted)), flow.filter(own)).orderBy("stream_id").collect()
    assert got == want and {r.basin_id for r in got} == set(wanted)
    nowhere = tables.ring_literal([(-9.0, -9.0), (-8.0, -9.0), (-8.0, -8.0), (-9.0, -9.0)])
    assert basins.region_network(cells, streams, flow, places, nowhere).count() == 0


def test_segment_lines_follow_their_cells(spark):
    held = catalog.QUERIES["basin_pipeline"](spark, SF).count()
    assert held > 0
    line = spark.sql("SELECT array(shiftleft(3L, 32) + 4, shiftleft(4L, 32) + 4) AS nodes").select(basins.line_of("nodes", 10.0, 20.0, 2.0).alias("l")).first().l
    assert [(p.x, p.y) for p in line] == [(19.0, 13.0), (19.0, 11.0)]
    ring = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D)) AS line").select(geometry.line_length(F.col("line")).alias("n")).first().n
    assert ring == 0


def test_modules_that_are_gone_are_skipped_and_broken_ones_are_not(tmp_path, monkeypatch):
    assert entry.optional("thalweg.gone.catalog") is None and entry.optional("no_such_module") is None
    (tmp_path / "bad_module.py").write_text("import a_package_that_is_not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry.optional("bad_module")


def test_unseen_components_equal_a_plain_version(spark):
    """All three rounds by repeated relaxation, on random grids."""
    from thalweg.operators import paths

    rng = random.Random(5)
    side, rows, want = 7, [], {}
    for basin in range(12):
        elev = {(r, c): 100 + rng.randrange(12) for r in range(side) for c in range(side)}
        comp = {k: 0 for k in elev}
        spots = rng.sample(sorted(elev), 6)
        for i, k in enumerate(spots):
            comp[k] = i + 1
        weight = {k: 0.0 if comp[k] else float(rng.randrange(8)) for k in elev}
        prob = {k: 1.0 if comp[k] else rng.choice([0.05, 0.3]) for k in elev}
        rows += [(basin, r, c, elev[r, c], weight[r, c], prob[r, c], comp[r, c], 1, comp[r, c] == 1, comp[r, c] > 0) for r, c in elev]
        nodes, sources, joined = {k for k in elev if prob[k] > 0.1}, {spots[0]}, {1}
        w = dict(weight)
        for cutoff in paths.CUTOFFS:
            dist, back = {k: (0.0 if k in sources else float("inf")) for k in nodes}, {}
            for _ in nodes:
                for r, c in sorted(nodes):
                    for dr in (-1, 0, 1):
                        for dc in (-1, 0, 1):
                            v = (r + dr, c + dc)
                            if (dr or dc) and v in nodes and dist[r, c] < float("inf"):
                                drop = max(0, elev[r, c] - elev[v])
                                cost = 1e30 if drop > 20 else max(w[r, c] * drop, drop) if drop else max(w[r, c], 0.0)
                                if dist[r, c] + cost <= cutoff and dist[r, c] + cost < dist[v]:
                                    dist[v], back[v] = dist[r, c] + cost, (r, c)
            reached = {i + 1 for i, k in enumerate(spots) if dist[k] < float("inf")}
            # ways of equal cost differ between the two, so only what the first round reaches is certain for later ones
            if cutoff == paths.CUTOFFS[0]:
                want[basin] = reached
    cells = spark.createDataFrame(rows, "basin_id long, r int, c int, elev int, weight double, prob double, comp int, main int, is_ref boolean, low boolean")
    left = lambda cut: {b: set(range(1, 7)) - {r.comp for r in paths.unseen_components(cells, cut).collect() if r.basin_id == b} for b in range(12)}
    first = left(paths.CUTOFFS[:1])
    assert first == want
    every = left(paths.CUTOFFS)
    assert all(first[b] <= every[b] for b in every) and any(first[b] < every[b] for b in every)


def test_places_are_looked_up_once(spark, monkeypatch):
    """Many points and vertices on few places: the search meets places, not rows, and all ties come out."""
    pts = spark.range(600).selectExpr("id AS point_id", "id % 2 AS grp", "id % 10 AS x", "id % 6 AS y")
    ref = spark.range(800).selectExpr("id AS vertex_id", "id % 2 AS grp", "(id % 4) * 5 AS x", "(id % 4) * 3 AS y")
    rows, held = [], lines.cut

    def counted(df, label, by=None):
        out = held(df, label, by)
        if label in ("nearest", "vertices"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(lines, "cut", counted)
    got = sorted(map(tuple, lines.nearest_vertices(pts, ref).collect()))
    assert 0 < sum(rows) < 500
    p, v = [tuple(r) for r in pts.collect()], [tuple(r) for r in ref.collect()]
    want = []
    for i, g, x, y in p:
        d = [((x - a) ** 2 + (y - b) ** 2, k) for k, h, a, b in v if h == g]
        want += [(g, i, k, e) for e, k in d if e == min(d)[0]]
    assert got == sorted(want)
    least = {}
    for g, i, k, _ in want:
        least[i] = min(k, least.get(i, k))
    assert {r.point_id: r.vertex_id for r in lines.connectors(pts, ref).collect()} == least
