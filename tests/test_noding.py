"""Crossings of lines against exact fractions, and polygons filled by spans against every midpoint."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from thalweg.operators import noding, spatial

VERTICES = "line_id long, pos int, x double, y double"


def meetings(lines):
    """(line, pos) -> exact places inside its step where another step meets it."""
    steps = [(i, k, *map(Fraction, (*a, *b))) for i, line in enumerate(lines) for k, (a, b) in enumerate(zip(line, line[1:])) if a != b]
    out = {}
    for i, k, x1, y1, x2, y2 in steps:
        found = set()
        for j, m, u1, v1, u2, v2 in steps:
            if (i, k) == (j, m):
                continue
            dx, dy, ex, ey, fx, fy = x2 - x1, y2 - y1, u2 - u1, v2 - v1, u1 - x1, v1 - y1
            d = dx * ey - dy * ex
            if d:
                t, u = (fx * ey - fy * ex) / d, (fx * dy - fy * dx) / d
                if 0 < t < 1 and 0 <= u <= 1:
                    found.add((x1 + t * dx, y1 + t * dy))
            elif fx * dy == fy * dx:
                for x, y in ((u1, v1), (u2, v2)):
                    if 0 < ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy) < 1:
                        found.add((x, y))
        out[i, k] = found
    return out


def lines_of(seed, n=14, spread=12):
    rng = random.Random(seed)
    lines = [[(rng.randint(0, spread), rng.randint(0, spread)) for _ in range(rng.randint(1, 7))] for _ in range(n)]
    return lines + [[(0, 5), (12, 5)], [(3, 5), (9, 5)], [(6, 0), (6, 5), (6, 12)], [(2, 2), (2, 2), (8, 8)], [(-40, 3), (60, 7)], [(4, 4)]]


def vertices(spark, lines):
    return spark.createDataFrame([(i, k, float(x), float(y)) for i, line in enumerate(lines) for k, (x, y) in enumerate(line)], VERTICES).repartition(3)


def test_meeting_points_are_those_of_exact_arithmetic(spark, monkeypatch):
    for seed, size, most in ((1, 3.0, 256), (2, 50.0, 4), (3, 0.7, 256)):
        monkeypatch.setattr(noding, "MOST_STEPS", most)  # with four, squares are cut again and again
        lines = lines_of(seed)
        got = {}
        for r in noding.meeting_points(noding.line_steps(vertices(spark, lines)), size).collect():
            assert 0 < r.t < 1
            got.setdefault((r.line_id, r.pos), []).append((r.x, r.y))
        for key, places in meetings(lines).items():
            close = lambda a: {(round(float(x), 9), round(float(y), 9)) for x, y in a}
            assert close(got.get(key, [])) == close(places), key
            assert len(got.get(key, [])) == len(close(got.get(key, [])))


def test_parts_end_at_nodes_and_cover_their_lines(spark):
    lines = lines_of(4)
    parts = noding.parts_of(noding.noded(vertices(spark, lines), 4.0)).orderBy("line_id", "part").collect()
    seen = {}
    for r in parts:
        seen.setdefault(r.line_id, []).append([(p.x, p.y) for p in r.line])
    length = lambda line: sum(((a - c) ** 2 + (b - d) ** 2) ** 0.5 for (a, b), (c, d) in zip(line, line[1:]))
    places = [p for own in seen.values() for part in own for p in part[1:-1]]
    assert len(set(places)) == len(places)  # nothing meets inside a part
    ends = {p for own in seen.values() for part in own for p in (part[0], part[-1])}
    assert not ends & set(places)
    for i, line in enumerate(lines):
        own = seen[i]
        assert abs(sum(map(length, own)) - length(line)) < 1e-9
        assert own[0][0] == line[0] and own[-1][-1] == line[-1] and all(a[-1] == b[0] for a, b in zip(own, own[1:]))


def test_crowded_squares_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(noding, "MOST_STEPS", 10)
    star = [[(0, 0), (10 * (i % 7 - 3), 10 * (i % 5 - 2) + i)] for i in range(40)]  # all through one place
    got = noding.meeting_points(noding.line_steps(vertices(spark, star)), 64.0)
    want = {k: v for k, v in meetings(star).items() if v}
    assert {(r.line_id, r.pos) for r in got.collect()} == set(want)
    assert noding.noded(vertices(spark, lines_of(1)).limit(0), 1.0).count() == 0


def test_spans_fill_what_the_even_odd_rule_holds(spark):
    rng = random.Random(5)
    shapes = []
    for i in range(12):
        rings = []
        for _ in range(rng.randint(1, 3)):
            ring = [(rng.randint(0, 80) / 4, rng.randint(0, 80) / 4) for _ in range(rng.randint(3, 7))]
            rings.append([*ring, ring[0]])
        shapes.append((i, rings))
    shapes += [(90, [[(0.5, 0.5), (4.5, 0.5), (4.5, 4.5), (0.5, 4.5), (0.5, 0.5)], [(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5), (1.5, 1.5)]]), (91, []), (92, [[]])]
    df = spark.createDataFrame(shapes, "polygon_id long, rings array<array<struct<x:double,y:double>>>")
    got = {}
    for r in spatial.filled_cells(df, 1.0).collect():
        got.setdefault(r.polygon_id, []).append((r.gx, r.gy))
    grid = df.select("polygon_id", "rings", F.explode(F.sequence(F.lit(-1), F.lit(21))).alias("gx")).withColumn("gy", F.explode(F.sequence(F.lit(-1), F.lit(21))))
    inside = spatial.inside_polygons(grid, F.col("gx") + 0.5, F.col("gy") + 0.5, F.col("rings")).filter("inside").collect()
    want = {}
    for r in inside:
        want.setdefault(r.polygon_id, []).append((r.gx, r.gy))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(got[90]) == 15


def test_touched_cells_of_long_steps(spark):
    rng = random.Random(6)
    steps = [(i, *(rng.randint(-40, 90) for _ in range(4))) for i in range(40)] + [(50, 3, 3, 3, 3), (51, 0, 0, 0, 50), (52, 0, 0, 50, 0)]
    df = spark.createDataFrame(steps, "k long, x1 long, y1 long, x2 long, y2 long")
    got = {tuple(r) for r in spatial.touched_cells(df, 4.0, 0.5, key=["k"]).collect()}
    want = set()
    for k, x1, y1, x2, y2 in steps:
        for n in range(2001):  # points along the step, closer together than a hundredth of a cell
            x, y = x1 + (x2 - x1) * n / 2000, y1 + (y2 - y1) * n / 2000
            for dx, dy in ((0, 0), (0.45, 0), (-0.45, 0), (0, 0.45), (0, -0.45), (0.3, 0.3), (-0.3, -0.3), (0.3, -0.3), (-0.3, 0.3)):
                want.add((k, int((x + dx) // 4), int((y + dy) // 4)))
    assert want <= got
    for k, gx, gy in got - want:  # at most touched at the rim of the buffer
        _, x1, y1, x2, y2 = next(s for s in steps if s[0] == k)
        near = min(max(gx * 4 - x, 0, x - gx * 4 - 4) ** 2 + max(gy * 4 - y, 0, y - gy * 4 - 4) ** 2 for n in range(4001) for x, y in [(x1 + (x2 - x1) * n / 4000, y1 + (y2 - y1) * n / 4000)])
        assert near <= 0.51**2


def test_points_in_polygons_are_those_of_every_pair(spark):
    """Places are tested once and only near a polygon's box; before, every pair of a group was tested."""
    rng = random.Random(8)
    pts = [(i, i % 3, rng.randint(0, 20), rng.randint(0, 20)) for i in range(300)]
    made = []
    for k in range(40):
        x, y = rng.uniform(-5, 22), rng.uniform(-5, 22)
        made.append((k, k % 4, [[(x, y), (x + 6, y + 1), (x + 5, y + 7), (x, y)], [(x + 3, y + 2), (x + 4, y + 2), (x + 4, y + 3), (x + 3, y + 2)], [(x + 8, y), (x + 9, y), (x + 9, y + 9), (x + 8, y)]]))
    points = spark.createDataFrame(pts, "point_id long, grp long, x long, y long")
    polygons = spark.createDataFrame(made, "polygon_id long, grp long, rings array<array<struct<x double, y double>>>")
    for size in (4.0, 50.0):
        got = sorted((r.point_id, r.polygon_id) for r in spatial.points_in_polygons(points, polygons, size, ["grp"]).collect())
        pairs = spatial.inside_polygons(points.join(polygons, "grp"), F.col("x"), F.col("y"), F.col("rings")).filter("inside")
        assert got == sorted((r.point_id, r.polygon_id) for r in pairs.collect()) and len(got) > 50
    every = spatial.inside_polygons(points.crossJoin(polygons.drop("grp")), F.col("x"), F.col("y"), F.col("rings")).filter("inside").count()
    assert spatial.points_in_polygons(points, polygons.drop("grp"), 4.0).count() == every


def test_steps_between_the_same_places_stand_for_each_other(spark, monkeypatch):
    """Lines over one another: only distinct steps meet in the squares, and every line gets its own meeting points."""
    base = [[(0, 0), (6, 6), (9, 1)], [(0, 6), (6, 0)], [(1, 3), (8, 3), (2, 3)]]
    lines = [line for line in base for _ in range(12)]
    sizes, held = [], noding.course_points

    def counted(steps, *args):
        sizes.append(steps.count())
        return held(steps, *args)

    monkeypatch.setattr(noding, "course_points", counted)
    got = {}
    for r in noding.meeting_points(noding.line_steps(vertices(spark, lines)), 4.0).collect():
        got.setdefault((r.line_id, r.pos), []).append((round(r.x, 6), round(r.y, 6)))
    want = {k: sorted((round(float(x), 6), round(float(y), 6)) for x, y in v) for k, v in meetings(lines).items() if v}
    assert {k: sorted(v) for k, v in got.items()} == want and sizes == [5]
