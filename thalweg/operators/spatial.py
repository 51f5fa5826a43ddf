"""Joins by place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounds, boxes_meet, in_ring, in_rings, line_meets_ring, polygon_meets_ring, step_box_distance2
from ..sources.tables import cut
from .lots import dealt


def box_join(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of rows whose boxes (left column a, right column b: structs of w, s, e, n) meet.

    Both sides are dealt to the squares of a grid that their boxes cover, and a pair is taken in the one square that holds
    the lower left corner of what they share: an equi-join without a broadcast and without duplicates to remove.
    """
    span = lambda box, lo, hi: F.sequence(F.floor(F.col(f"{box}.{lo}") / size), F.floor(F.col(f"{box}.{hi}") / size))
    dealt = lambda df, box: df.withColumn("gx", F.explode(span(box, "w", "e"))).withColumn("gy", F.explode(span(box, "s", "n")))
    both = dealt(left, "a").join(dealt(right, "b"), ["gx", "gy"])
    here = (F.floor(F.greatest("a.w", "b.w") / size) == F.col("gx")) & (F.floor(F.greatest("a.s", "b.s") / size) == F.col("gy"))
    return both.filter(boxes_meet("a", "b") & here).drop("gx", "gy")


def inside_polygon(points: DataFrame, x: Column, y: Column, ring: Column) -> DataFrame:
    """points with `inside`; the ring is a column, so every row may have its own."""
    return points.withColumn("inside", in_ring(x, y, ring))


def inside_polygons(points: DataFrame, x: Column, y: Column, rings: Column) -> DataFrame:
    """points with `inside`; rings is a column of a polygon's closed rings, holes and further parts among them."""
    return points.withColumn("inside", in_rings(x, y, rings))


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, group: list[str] | None = None, rings: str = "rings") -> DataFrame:
    """The columns of points (x, y) and of polygons but rings of every pair of one group whose point lies in the polygon.

    Places are tested once, however many points lie on them, and only against polygons whose box holds them: boxes are
    dealt to the squares of a grid that they cover, as far as there are points of their group, and places to their own square.
    """
    group = group or []
    square = lambda c: F.floor(F.col(c) / size)
    places = cut(points.select(*group, "x", "y").filter("x IS NOT NULL AND y IS NOT NULL").distinct(), "places")
    extent = places.groupBy(*group).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    own = polygons.withColumn("_box", bounds(F.flatten(F.col(rings))))
    own = own.join(extent, group) if group else own.crossJoin(extent)
    own = own.filter("_box.w <= _x1 AND _box.e >= _x0 AND _box.s <= _y1 AND _box.n >= _y0")
    span = lambda lo, hi, a, b: F.sequence(F.floor(F.greatest(F.col(lo), F.col(a)) / size), F.floor(F.least(F.col(hi), F.col(b)) / size))
    own = own.withColumn("_gx", F.explode(span("_box.w", "_box.e", "_x0", "_x1"))).withColumn("_gy", F.explode(span("_box.s", "_box.n", "_y0", "_y1"))).drop("_x0", "_x1", "_y0", "_y1")
    met = own.hint("merge").join(places.withColumns({"_gx": square("x"), "_gy": square("y")}), [*group, "_gx", "_gy"])
    met = met.filter("x BETWEEN _box.w AND _box.e AND y BETWEEN _box.s AND _box.n").filter(in_rings(F.col("x"), F.col("y"), F.col(rings)))
    return points.join(met.drop("_gx", "_gy", "_box", rings).hint("merge"), [*group, "x", "y"])


def filled_cells(polygons: DataFrame, size: float, key: str = "polygon_id", rings: str = "rings") -> DataFrame:
    """key, gx, gy: cells of a grid whose midpoint lies in a polygon with holes and parts, by the even-odd rule.

    Sides are dealt to the rows of midpoints that they cross, the crossings of each row are sorted, and cells are spans
    between every other two: work grows with the outline and with the cells that come out, no cell is tested by itself.
    """
    edge = F.explode(F.flatten(F.transform(rings, lambda r: F.transform(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), r[i + 1].alias("b"))))))
    sides = polygons.select(key, edge.alias("e")).select(key, *(F.col(f"e.{p}.{k}").cast("double").alias(f"{p}{k}") for p in "ab" for k in "xy"))
    first = lambda v: F.ceil(v / size - 0.5)  # noqa: E731  the first midpoint from there on
    sides = sides.withColumns({"from": first(F.least("ay", "by")), "to": first(F.greatest("ay", "by")) - 1}).filter("from <= to")
    rows = sides.withColumn("gy", F.explode(F.sequence("from", "to")))
    y = (F.col("gy") + 0.5) * size
    rows = rows.select(key, "gy", ((F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")).alias("x"))
    spans = rows.groupBy(key, "gy").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # as many as the outline crosses that row
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2) - 1), lambda i: F.struct(F.get("xs", (2 * i).cast("int")).alias("a"), F.get("xs", (2 * i + 1).cast("int")).alias("b"))))
    cells = spans.select(key, "gy", pair.alias("p")).select(key, "gy", first(F.col("p.a")).alias("a"), (first(F.col("p.b")) - 1).alias("b")).filter("a <= b")
    return cells.select(key, F.explode(F.sequence("a", "b")).alias("gx"), "gy")


def sample_grid(points: DataFrame, cells: DataFrame, size: float, west: float = 0.0, south: float = 0.0) -> DataFrame:
    """points with the cell columns of the nearest cell centre (gx, gy), null where there is no cell."""
    at = points.withColumns({"gx": F.floor((F.col("x") - west) / size).cast("int"), "gy": F.floor((F.col("y") - south) / size).cast("int")})
    return at.join(cells, ["gx", "gy"], "left")


def meeting(lines: DataFrame, ring: Column, line: str = "line") -> DataFrame:
    """Lines that meet a polygon: their boxes first, then vertices and steps themselves."""
    edge = lambda of, k, f: f(F.transform(of, lambda p: p[k]))
    own = F.col(line)
    boxes = (edge(own, "x", F.array_min) <= edge(ring, "x", F.array_max)) & (edge(ring, "x", F.array_min) <= edge(own, "x", F.array_max)) & (edge(own, "y", F.array_min) <= edge(ring, "y", F.array_max)) & (edge(ring, "y", F.array_min) <= edge(own, "y", F.array_max))
    return lines.filter(boxes & line_meets_ring(own, ring))


def meeting_polygons(polygons: DataFrame, ring: Column, rings: str = "rings") -> DataFrame:
    """Polygons (arrays of rings, the outer one first) that meet a polygon: their boxes first, then corners and sides."""
    own, other = bounds(F.get(rings, F.lit(0))), bounds(ring)
    boxes = (own["w"] <= other["e"]) & (other["w"] <= own["e"]) & (own["s"] <= other["n"]) & (other["s"] <= own["n"])
    return polygons.filter(boxes & polygon_meets_ring(F.col(rings), ring))


#: Cells that a task looks at together.
CELLS_AT_ONCE = 1 << 18


def unfolded(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and number of first[row], .., last[row] of every row, CELLS_AT_ONCE at a time."""
    ends = np.cumsum(np.maximum(last - first + 1, 0))
    for lo in range(0, int(ends[-1]) if len(ends) else 0, CELLS_AT_ONCE):
        k = np.arange(lo, min(lo + CELLS_AT_ONCE, int(ends[-1])))
        row = np.searchsorted(ends, k, "right")
        yield row, last[row] - (ends[row] - 1 - k)


def cells_beside(x1, y1, x2, y2, size: float, buffer: float, west: float, south: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """step, gx, gy of the cells within `buffer` of steps (arrays)."""
    span = lambda lo, hi, start: (np.ceil((lo - buffer - start) / size).astype(np.int64) - 1, np.floor((hi + buffer - start) / size).astype(np.int64))
    low, high = np.minimum(x1, x2), np.maximum(x1, x2)
    for step, gx in unfolded(*span(low, high, west)):
        # what of the step lies within the buffer of the column
        a, b, c, d = x1[step], y1[step], x2[step], y2[step]
        flat = c == a
        at = lambda x: b + (np.minimum(np.maximum(x, low[step]), high[step]) - a) * (d - b) / np.where(flat, 1.0, c - a)  # noqa: B023, E731
        left = west + gx * size - buffer
        enters, leaves = np.where(flat, b, at(left)), np.where(flat, d, at(left + size + 2 * buffer))
        for column, gy in unfolded(*span(np.minimum(enters, leaves), np.maximum(enters, leaves), south)):
            w, s = west + gx[column] * size, south + gy * size
            near = np.flatnonzero(step_box_distance2(a[column], b[column], c[column], d[column], w, s, w + size, s + size) <= buffer * buffer)
            yield step[column[near]], gx[column[near]], gy[near]


def touched_cells(steps: DataFrame, size: float, buffer: float, west: float = 0.0, south: float = 0.0, key: list[str] | None = None) -> DataFrame:
    """key, gx, gy: cells of a grid whose box lies within `buffer` of a step (x1, y1, x2, y2) of a line, each once a key.

    A step is dealt to the columns that it and its buffer reach, and in each to the rows between where it enters and
    leaves it, so a long step costs as many cells as it is long. Steps are few bytes and many cells, so they are dealt to
    all tasks by key; a task looks at many cells together and makes its keys' cells distinct.
    """
    key = key or []
    ends = ["x1", "y1", "x2", "y2"]
    held = steps.select(*key, *(F.col(c).cast("double").alias(c) for c in ends)).dropna(subset=ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(key)
            for step, gx, gy in cells_beside(*(batch.column(c).to_numpy() for c in ends), size, buffer, west, south):
                columns = own.take(pa.array(step)).columns if key else []
                yield pa.RecordBatch.from_arrays([*columns, pa.array(gx), pa.array(gy)], [*key, "gx", "gy"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*key).schema), "gx long", "gy long"])
    return dealt(held, *key).mapInArrow(run, schema).distinct()
