"""GeoPackage tables, headers of rasters, tables that are pruned by place, and rasters of many boxes."""

import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from thalweg.functions.geometry import bounds
from thalweg.sources import geopackage, geotiff, tables


def wkb(kind, parts, order="<", z=False):
    code = kind + 1000 * z
    point = lambda p: struct.pack(order + "dd" + "d" * z, *p, *([7.0] * z))
    head = bytes([order == "<"]) + struct.pack(order + "I", code)
    count = lambda n: struct.pack(order + "I", n)
    if kind == geopackage.POINT:
        return head + point(parts[0][0])
    if kind == geopackage.LINE:
        return head + count(len(parts[0])) + b"".join(map(point, parts[0]))
    if kind == geopackage.POLYGON:
        return head + count(len(parts)) + b"".join(count(len(r)) + b"".join(map(point, r)) for r in parts)
    return head + count(len(parts)) + b"".join(wkb(kind - 3, p if kind == geopackage.MULTI_POLYGON else [p], order, z) for p in parts)


def blob(kind, parts, bounded=True, **how):
    flat = [p for part in (sum(parts, []) if kind == geopackage.MULTI_POLYGON else parts) for p in part]
    xs, ys = zip(*flat)
    box = struct.pack("<4d", min(xs), max(xs), min(ys), max(ys)) if bounded else b""
    return b"GP\0" + bytes([1 | (2 if bounded else 0)]) + struct.pack("<i", 4326) + box + wkb(kind, parts, **how)


def package(path, rows, index=True):
    con = sqlite3.connect(path)
    con.executescript("""CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT);
INSERT INTO gpkg_contents VALUES ('streams', 'features'); INSERT INTO gpkg_geometry_columns VALUES ('streams', 'geom');
CREATE TABLE streams (fid INTEGER PRIMARY KEY, geom BLOB, LINKNO INTEGER, "strm order" MEDIUMINT, name TEXT(20), slope DOUBLE, main BOOLEAN);""")
    con.executemany("INSERT INTO streams VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
    if index:
        con.execute("CREATE VIRTUAL TABLE rtree_streams_geom USING rtree(id, minx, maxx, miny, maxy)")
        for fid, g, *_ in rows:
            if (b := geopackage.box_of(g)) is not None:
                con.execute("INSERT INTO rtree_streams_geom VALUES (?, ?, ?, ?, ?)", (fid, b[0], b[2], b[1], b[3]))
    con.commit()
    con.close()


@pytest.mark.parametrize(("index", "bounded"), [(True, True), (False, True), (False, False)])
def test_geopackage_round_trip(spark, tmp_path, index, bounded):
    rng = random.Random(1)
    point = lambda: (rng.randint(0, 100) / 4, rng.randint(0, 100) / 4)
    shapes = []
    for i in range(300):
        kind = (geopackage.LINE, geopackage.MULTI_LINE, geopackage.POLYGON, geopackage.POINT)[i % 4]
        parts = [[point() for _ in range(1 if kind == geopackage.POINT else rng.randint(2, 6))] for _ in range(1 if kind in (geopackage.POINT, geopackage.LINE) else 2)]
        shapes.append((kind, parts))
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    hole = [(2.0, 1.0), (3.0, 1.0), (3.0, 2.0), (2.0, 1.0)]
    rows = [(2 * i + 1, blob(k, p, bounded, order="<>"[i % 2], z=i % 5 == 0), i, i % 9, None if i % 7 == 0 else f"n{i}", i / 3, i % 2) for i, (k, p) in enumerate(shapes)]
    rows += [(9001, blob(geopackage.MULTI_POLYGON, [[ring, hole], [ring]], bounded), 300, None, "é", None, None), (9002, None, 301, 1, "none", 0.0, 1)]
    path = str(tmp_path / "a b.gpkg")
    package(path, rows, index)
    df = geopackage.scan_geopackage(spark, path, rows=70)
    assert df.rdd.getNumPartitions() > 5 and [f.dataType.simpleString() for f in df.schema.fields[2:]] == ["bigint", "int", "string", "double", "boolean"]
    got = {r.LINKNO: r for r in df.collect()}
    assert len(got) == 302 and got[301].geom is None
    for i, (k, p) in enumerate(shapes):
        r = got[i]
        assert (r.geom.kind, [[tuple(x) for x in part] for part in r.geom.parts]) == (k, p)
        assert (r["strm order"], r.name, r.slope, r.main) == (i % 9, None if i % 7 == 0 else f"n{i}", i / 3, bool(i % 2))
    assert [[tuple(x) for x in part] for part in got[300].geom.parts] == [ring, hole, ring]
    narrow = geopackage.scan_geopackage(spark, path, "streams", ["LINKNO", "strm order"], box=(3, 3, 8, 9))
    assert narrow.columns == ["LINKNO", "strm order"]
    near = lambda p: min(x for x, _ in p) <= 8 and max(x for x, _ in p) >= 3 and min(y for _, y in p) <= 9 and max(y for _, y in p) >= 3
    assert sorted(r.LINKNO for r in narrow.collect()) == [i for i, (_, p) in enumerate(shapes) if near(sum(p, []))] + [300]
    with pytest.raises(Exception, match="no such columns"):
        geopackage.scan_geopackage(spark, path, columns=["nothing"]).count()


def test_empty_geopackage(spark, tmp_path):
    path = str(tmp_path / "none.gpkg")
    package(path, [])
    assert geopackage.scan_geopackage(spark, path).count() == 0


def tiff(order, big, width, height, scale, tie):
    doubles = lambda xs: struct.pack(f"{order}{len(xs)}d", *xs)
    head, size = (16, 20) if big else (8, 12)
    start = head + (8 if big else 2) + 4 * size + (8 if big else 4)
    word = "Q" if big else "I"
    entry = lambda tag, kind, n, value: struct.pack(f"{order}HH{word}", tag, kind, n) + value
    room = 8 if big else 4
    short = lambda v: struct.pack(order + "H", v).ljust(room, b"\0")
    tags = [entry(256, 3, 1, short(width)), entry(257, 3, 1, short(height)), entry(33550, 12, 3, struct.pack(order + word, start)), entry(33922, 12, 6, struct.pack(order + word, start + 24))]
    first = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    return first + struct.pack(order + ("Q" if big else "H"), 4) + b"".join(tags) + b"\0" * room + doubles(scale) + doubles(tie)


def test_boxes_from_headers(spark, tmp_path):
    want = {}
    for i, (order, big) in enumerate([("<", False), (">", False), ("<", True), (">", True)]):
        (tmp_path / f"t{i}.tif").write_bytes(tiff(order, big, 100, 50, (0.5, 0.25, 0), (0, 0, 0, 10.0 + i, 60.0, 0)))
        want[f"t{i}.tif"] = (10.0 + i, 47.5, 60.0 + i, 60.0)
    (tmp_path / "moved.tif").write_bytes(tiff("<", False, 10, 10, (1, 1, 0), (2, 3, 0, 5, 5, 0)))
    want["moved.tif"] = (3.0, -2.0, 13.0, 8.0)
    for name, data in (("broken.tif", b"II*\0\xff\xff\xff\x7f" + b"\0" * 20), ("empty.tif", b""), ("text.tif", b"not a raster at all"), ("other.txt", tiff("<", False, 1, 1, (1, 1, 0), (0,) * 6))):
        (tmp_path / name).write_bytes(data)
    got = {r.file_name.rsplit("/", 1)[1]: (r.w, r.s, r.e, r.n) for r in geotiff.header_index(spark, str(tmp_path)).collect()}
    assert got == want


def read_rows(df):
    """Rows that the scan of a plan gave, after it has run."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    plan, todo = None, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            plan = node
            break
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return plan.metrics().apply("numOutputRows").value()


def test_scans_of_a_place_skip_what_lies_elsewhere(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        x, y = rng.uniform(0, 100), rng.uniform(0, 100)
        rows.append((i, [(x + rng.uniform(0, 2), y + rng.uniform(0, 2)) for _ in range(rng.randint(1, 4))]))
    df = spark.createDataFrame(rows, "line_id long, line array<struct<x:double,y:double>>").repartition(5)
    path, ring = str(tmp_path / "lines"), [(10.0, 10.0), (22.0, 11.0), (16.0, 25.0), (10.0, 10.0)]
    tables.write_by_place(df, path, bounds(F.col("line")), files=4, **{"parquet.block.size": "4096", "parquet.page.size": "1024", "parquet.page.row.count.limit": "64"})
    found = tables.scan_place(spark, path, ["line_id"], ring)
    plain = tables.scan_lines(spark, path, ["line_id", "line"], tables.line_meets_ring(F.col("line"), tables.ring_literal(ring)))
    assert sorted(r.line_id for r in found.collect()) == sorted(r.line_id for r in plain.select("line_id").collect()) and found.count() > 20
    text = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert all(f"{f}({c}," in text for c, f in (("w", "LessThanOrEqual"), ("e", "GreaterThanOrEqual"), ("s", "LessThanOrEqual"), ("n", "GreaterThanOrEqual")))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        near = spark.read.parquet(path).filter(tables.box_filter(tables.ring_box(ring))).select("line_id")
        assert read_rows(near) < 0.5 * read_rows(spark.read.parquet(path).select("line_id")) == 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    tables.write_by_place(df.limit(0), path, bounds(F.col("line")))
    assert tables.scan_place(spark, path, ["line_id"], ring).count() == 0


def test_rasters_of_many_boxes_equal_those_of_single_ones(spark):
    rng = random.Random(3)
    cells = [(t, r, c, rng.choice([rng.randint(0, 80), 95])) for t in range(6) for r in range(t * 3, t * 3 + 9) for c in range(20) if rng.random() < 0.8]
    boxes = [(i, r, r + rng.randint(0, 6), c, c + rng.randint(0, 6)) for i in range(25) for r, c in [(rng.randint(-3, 26), rng.randint(-3, 20))]]
    tiles = spark.createDataFrame(cells, "tile int, r int, c int, v int")
    table = spark.createDataFrame(boxes, "box_id int, r0 int, r1 int, c0 int, c1 int")
    got = {}
    for r in tables.box_rasters(tiles, table, "tile", "v", size=4, nodata=90).collect():
        got.setdefault(r.box_id, []).append((r.r, r.c, r.v))
    for i, *b in boxes[::5]:
        assert sorted(got[i]) == sorted(map(tuple, tables.box_raster(tiles, "tile", "v", tuple(b), nodata=90).collect()))
    assert {i: len(x) for i, x in got.items()} == {i: (r1 - r0 + 1) * (c1 - c0 + 1) for i, r0, r1, c0, c1 in boxes}
    assert tables.box_rasters(tiles, table.limit(0), "tile", "v").count() == 0


def test_regions_keep_their_holes(spark, tmp_path):
    path = tmp_path / "regions.json"
    path.write_text("""{"features": [
 {"properties": {"HYBAS_ID": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[9,0],[9,9],[0,9],[0,0]], [[3,3],[6,3],[6,6],[3,6],[3,3]]]}},
 {"properties": {"HYBAS_ID": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[20,20],[22,20],[22,22],[20,20]]], [[[30,30],[32,30],[32,32],[30,30]]]]}}]}""")
    got = tables.scan_regions(spark, str(path)).collect()
    assert sorted((r.region_id, len(r.rings), len(r.ring)) for r in got) == [(1, 2, 5), (2, 1, 4), (2, 1, 4)]
    inside_the_hole = [(4.0, 4.0), (5.0, 4.0), (5.0, 5.0), (4.0, 4.0)]
    assert tables.scan_regions(spark, str(path), mask=inside_the_hole).count() == 0
    assert [r.region_id for r in tables.scan_regions(spark, str(path), mask=[(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]).collect()] == [1]
    assert [r.region_id for r in tables.scan_regions(spark, str(path), mask=[(21.0, 18.0), (21.5, 40.0), (21.2, 40.0), (21.0, 18.0)]).collect()] == [2]


def test_places_of_boxes_try_few_of_many_tiles(spark, monkeypatch):
    """Sixty tiles that share all their places: a place looks at the first ones, and boxes of the same places are made once."""
    rng = random.Random(4)
    cells = [(t, r, c, 95 if t < 7 and r < 4 else rng.randint(0, 80)) for t in range(60) for r in range(12) for c in range(12)]
    boxes = [(i, i % 9, i % 9 + 2, i % 8, i % 8 + 3) for i in range(400)]
    tiles = spark.createDataFrame(cells, "tile int, r int, c int, v int")
    table = spark.createDataFrame(boxes, "box_id int, r0 int, r1 int, c0 int, c1 int")
    tried, held = [], tables.cut

    def counted(df, label, by=None):
        out = held(df, label, by)
        if label == "tried":
            tried.append(out.count())
        return out

    monkeypatch.setattr(tables, "cut", counted)
    got = {}
    for r in tables.box_rasters(tiles, table, "tile", "v", size=4, nodata=90).collect():
        got.setdefault(r.box_id, []).append((r.r, r.c, r.v))
    for i, *b in boxes[::97]:
        assert sorted(got[i]) == sorted(map(tuple, tables.box_raster(tiles, "tile", "v", tuple(b), nodata=90).collect()))
    assert len(got) == 400 and 0 < sum(tried) <= 72 * 12 * 20  # of 400 boxes * 12 places * 60 tiles
