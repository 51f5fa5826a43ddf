"""From thinned cells to polylines, and their connection to reference water."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.cells import STEPS
from ..sources.tables import cut
from .guard import Failures, per_basin

def trace_cells(cells: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Lines over the cells: runs between ends and junctions, then closed rings; single cells make none.

    A diagonal step counts only where no cell beside both of its ends is water, so blocks of four make no triangle.
    """
    near: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        own = [(r + dr, c + dc) for dr, dc in STEPS.values() if (r + dr, c + dc) in cells]
        near[r, c] = [(a, b) for a, b in own if a == r or b == c or ((r, b) not in cells and (a, c) not in cells)]
    seen: set[frozenset] = set()
    out = []

    def walk(at, to):
        line = [at, to]
        seen.add(frozenset((at, to)))
        while len(near[to]) == 2:
            ahead = next((x for x in near[to] if frozenset((to, x)) not in seen), None)
            if ahead is None:
                break
            seen.add(frozenset((to, ahead)))
            at, to = to, ahead
            line.append(to)
        out.append(line)

    ends = sorted((x for x in near if len(near[x]) != 2), key=lambda x: (len(near[x]) != 1, x))
    for x in [*ends, *sorted(near)]:
        for y in near[x]:
            if frozenset((x, y)) not in seen:
                walk(x, y)
    return out


def trace(cells: DataFrame, failures: Failures | None = None) -> DataFrame:
    """basin_id, line_id, pos, r, c: the vertices of the lines through each basin's water that is not reference water, with the reference cells that they touch."""

    def run(basin: pd.DataFrame) -> pd.DataFrame:
        lines = trace_cells(set(zip(basin["r"].tolist(), basin["c"].tolist(), strict=True)))
        rows = [(i, p, r, c) for i, line in enumerate(lines) for p, (r, c) in enumerate(line)]
        return pd.DataFrame(rows, columns=["line_id", "pos", "r", "c"]).astype("int32").assign(basin_id=basin["basin_id"].iloc[0])[["basin_id", "line_id", "pos", "r", "c"]]

    return per_basin(cells, run, "basin_id long, line_id int, pos int, r int, c int", failures, "trace")


def snap_points(vertices: DataFrame, line: list[str]) -> DataFrame:
    """line, n_vertices, action (drop, snap, none), pos of each line; column touches says which vertices touch reference water.

    Lines that touch at both ends are dropped; else the head snaps, else the tail, else the first vertex between that touches.
    """
    ends = vertices.groupBy(*line).agg(F.count("*").alias("n_vertices"), F.max("pos").alias("last"), F.min(F.when(F.col("touches"), F.col("pos"))).alias("first_touch"), F.max(F.when(F.col("touches"), F.col("pos"))).alias("last_touch"))
    head, tail = F.coalesce(F.col("first_touch") == 0, F.lit(False)), F.coalesce(F.col("last_touch") == F.col("last"), F.lit(False))
    action = F.when(head & tail, "drop").when(F.col("first_touch").isNotNull(), "snap").otherwise("none")
    pos = F.when(head & tail, None).when(head, 0).when(tail, F.col("last")).otherwise(F.col("first_touch"))
    return ends.select(*line, "n_vertices", action.alias("action"), pos.cast("int").alias("pos"))


def nearest_places(points: DataFrame, vertices: DataFrame, group: str = "grp", size: float | None = None) -> DataFrame:
    """group, x, y, vx, vy, d2: the nearest places of vertices of every place of points in its group, all of them if several are.

    Places are looked up once, however many points and vertices lie on them. They are dealt to the squares of a grid, and
    every point's place looks into its own square and the eight around it. What it finds there is nearest if it lies no
    farther than a square's side; the places that are left go on with squares of four times the side. By default the
    first side gives a square one place of its group on average. Only the nearest is kept of what a place finds. Joins of
    places are shuffled: a small file of them may still be many rows for a driver to send.
    """
    there = cut(vertices.groupBy(group, F.col("x").alias("vx"), F.col("y").alias("vy")).agg(F.count("*").alias("held")), "vertex-places")
    here = points.select(group, "x", "y").distinct()
    edges = lambda df, x, y: df.groupBy(group).agg(F.count("*").alias("n"), *(f(c).cast("double").alias(f"{f.__name__}_{k}") for c, k in ((x, "x"), (y, "y")) for f in (F.min, F.max)))
    here = cut(here, "point-places")
    own, other = edges(there, "vx", "vy"), edges(here, "x", "y").drop("n")
    both = own.join(other.withColumnsRenamed({c: f"p_{c}" for c in other.columns if c != group}), group)
    wide = lambda c: F.greatest(f"max_{c}", f"p_max_{c}") - F.least(f"min_{c}", f"p_min_{c}")
    both = both.withColumn("extent", F.greatest(wide("x"), wide("y"), F.lit(1e-9)))
    side = F.lit(float(size)) if size else F.greatest(F.col("extent") / F.sqrt("n"), F.col("extent") / 2**20)
    sides = both.select(group, side.alias("side"), "extent")
    held = cut(there.select(group, "vx", "vy").join(sides.select(group, "side"), group), "vertices")
    left = cut(here.join(sides, group), "points")
    out, scale = None, 1
    while not left.isEmpty():
        span = F.col("side") * scale
        at = lambda c: F.floor(F.col(c) / span).cast("long")  # noqa: B023, E731
        near = left.withColumn("gx", F.explode(F.sequence(at("x") - 1, at("x") + 1))).withColumn("gy", F.explode(F.sequence(at("y") - 1, at("y") + 1)))
        met = near.join(held.withColumns({"gx": at("vx"), "gy": at("vy")}).drop("side").hint("merge"), [group, "gx", "gy"], "left")
        met = met.withColumn("d2", (F.col("x") - F.col("vx")) ** 2 + (F.col("y") - F.col("vy")) ** 2)
        # nine squares of twice the extent hold everything
        sure = F.coalesce((F.col("d2") <= span * span) | (span > 2 * F.col("extent")), F.lit(False))
        first = met.withColumn("rank", F.rank().over(Window.partitionBy(group, "x", "y").orderBy(F.col("d2").asc_nulls_last()))).filter("rank = 1")
        first = cut(first.select(group, "x", "y", "side", "extent", "vx", "vy", "d2", (sure & F.col("d2").isNotNull()).alias("sure")), "nearest")
        found = first.filter("sure").select(group, "x", "y", "vx", "vy", "d2")
        out = found if out is None else out.unionByName(found)
        left = cut(first.filter("NOT sure").select(*left.columns).distinct(), "points")
        scale *= 4
    return left.select(group, "x", "y", F.col("x").alias("vx"), F.col("y").alias("vy"), F.lit(0.0).alias("d2")) if out is None else out


def nearest_vertices(points: DataFrame, vertices: DataFrame, group: str = "grp", size: float | None = None) -> DataFrame:
    """group, point_id, vertex_id, dist2: the nearest vertex of the point's group, all of them if several are (see nearest_places)."""
    near = nearest_places(points, vertices, group, size)
    at = vertices.select(group, "vertex_id", F.col("x").alias("vx"), F.col("y").alias("vy"))
    found = points.select(group, "point_id", "x", "y").join(near.hint("merge"), [group, "x", "y"]).join(at.hint("merge"), [group, "vx", "vy"])
    return found.select(group, "point_id", "vertex_id", F.col("d2").cast("long").alias("dist2"))


def connectors(points: DataFrame, vertices: DataFrame, group: str = "grp") -> DataFrame:
    """group, point_id, vertex_id, line: from each point to its nearest vertex (of several the one of smallest identifier), which takes the point's place."""
    least = vertices.groupBy(group, F.col("x").alias("vx"), F.col("y").alias("vy")).agg(F.min("vertex_id").alias("vertex_id"))
    near = nearest_places(points, vertices, group).join(least.hint("merge"), [group, "vx", "vy"])
    first = near.groupBy(group, "x", "y").agg(F.min(F.struct("vertex_id", "vx", "vy")).alias("v")).select(group, "x", "y", "v.*")
    joined = points.select(group, "point_id", "x", "y").join(first.hint("merge"), [group, "x", "y"])
    return joined.select(group, "point_id", "vertex_id", F.array(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), F.struct(F.col("vx").cast("double").alias("x"), F.col("vy").cast("double").alias("y"))).alias("line"))


def vertices_of(lines: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """key, pos, x, y: all vertices of lines (arrays of structs x, y)."""
    return lines.select(key, F.posexplode(line).alias("pos", "p")).select(key, "pos", "p.x", "p.y")


def single_lines(multi: DataFrame, key: str = "line_id", parts: str = "parts") -> DataFrame:
    """key, part, line: one row for each line of a multi-line; those without lines give none."""
    return multi.select(key, F.posexplode(parts).alias("part", "line"))


def with_reference(new: DataFrame, reference: DataFrame) -> DataFrame:
    return new.withColumn("from_ref", F.lit(False)).unionByName(reference.withColumn("from_ref", F.lit(True)))


@F.pandas_udf(BinaryType())
def line_wkb(lines: pd.Series) -> pd.Series:
    """Little-endian WKB of arrays of structs x, y."""
    return lines.map(lambda line: None if line is None else struct.pack("<BII", 1, 2, len(line)) + b"".join(struct.pack("<dd", p["x"], p["y"]) for p in line))
