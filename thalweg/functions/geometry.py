"""Geometry without a geometry library: boxes, rings, lines, WKB."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def boxes_meet(a: str, b: str) -> Column:
    """Whether two closed boxes, structs of w, s, e, n, have a point in common."""
    c = lambda side, k: F.col(f"{side}.{k}")
    return (c(a, "w") <= c(b, "e")) & (c(b, "w") <= c(a, "e")) & (c(a, "s") <= c(b, "n")) & (c(b, "s") <= c(a, "n"))


def buffered(box: str, by: float) -> Column:
    return F.struct((F.col(f"{box}.w") - by).alias("w"), (F.col(f"{box}.s") - by).alias("s"), (F.col(f"{box}.e") + by).alias("e"), (F.col(f"{box}.n") + by).alias("n"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; ring is a closed array of structs x, y. Points on the west and south sides are inside."""
    crossings = F.aggregate(
        F.sequence(F.lit(0), F.size(ring) - 2),
        F.lit(0),
        lambda n, i: n + F.when(
            ((ring[i]["y"] > y) != (ring[i + 1]["y"] > y))
            & (x < (ring[i + 1]["x"] - ring[i]["x"]) * (y - ring[i]["y"]) / F.nullif(ring[i + 1]["y"] - ring[i]["y"], F.lit(0.0)) + ring[i]["x"]),
            1,
        ).otherwise(0),
    )
    return F.when(F.size(ring) < 4, F.lit(False)).otherwise(crossings % 2 == 1)


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings of a polygon (array of closed rings): holes are outside, and so are gaps between parts."""
    return F.aggregate(rings, F.lit(False), lambda inside, ring: inside != in_ring(x, y, ring))


def bounds(line: Column) -> Column:
    """w, s, e, n of an array of structs x, y; nulls of an empty one."""
    edge = lambda k, f: f(F.transform(line, lambda p: p[k])).cast("double")
    return F.struct(edge("x", F.array_min).alias("w"), edge("y", F.array_min).alias("s"), edge("x", F.array_max).alias("e"), edge("y", F.array_max).alias("n"))


def line_length(line: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(line) - 2), lambda i: F.hypot(line[i + 1]["x"] - line[i]["x"], line[i + 1]["y"] - line[i]["y"]))
    return F.when(F.size(line) < 2, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b))


def side_of(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """On which side of the line a to b a point lies: the sign of this, 0 on the line."""
    return (bx - ax) * (y - ay) - (by - ay) * (x - ax)


def steps_cross(p: Column, q: Column, a: Column, b: Column) -> Column:
    """Whether the steps p to q and a to b (structs x, y) cross each other properly."""
    side = lambda s, t, u: F.signum(side_of(s["x"], s["y"], t["x"], t["y"], u["x"], u["y"]))
    return (side(p, q, a) * side(p, q, b) < 0) & (side(a, b, p) * side(a, b, q) < 0)


def line_meets_ring(line: Column, ring: Column) -> Column:
    """Whether a line (array of structs x, y) has a vertex in the ring or a step across one of its sides."""
    inside = F.exists(line, lambda p: in_ring(p["x"], p["y"], ring))
    steps = F.when(F.size(line) > 1, F.sequence(F.lit(0), F.size(line) - 2)).otherwise(F.array().cast("array<int>"))
    across = F.exists(steps, lambda i: F.exists(F.sequence(F.lit(0), F.size(ring) - 2), lambda j: steps_cross(line[i], line[i + 1], ring[j], ring[j + 1])))
    return inside | across


def polygon_meets_ring(rings: Column, ring: Column) -> Column:
    """Whether a polygon (array of rings) and the inside of a ring have a point in common: a corner of one in the other, or sides that cross."""
    return F.exists(rings, lambda r: line_meets_ring(r, ring)) | F.exists(ring, lambda p: in_rings(p["x"], p["y"], rings))


def step_box_distance2(x1, y1, x2, y2, w, s, e, n) -> np.ndarray:
    """Squared distance between steps and boxes, row by row (arrays of doubles); 0 where they meet."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    to_box = lambda x, y: np.maximum(np.maximum(w - x, 0.0), x - e) ** 2 + np.maximum(np.maximum(s - y, 0.0), y - n) ** 2
    out = np.minimum(to_box(x1, y1), to_box(x2, y2))
    left, right = np.zeros(len(out), bool), np.zeros(len(out), bool)
    for x, y in ((w, s), (e, s), (w, n), (e, n)):
        side = dx * (y - y1) - dy * (x - x1)
        left, right = left | (side <= 0), right | (side >= 0)
        t = np.maximum(0.0, np.minimum(1.0, ((x - x1) * dx + (y - y1) * dy) / np.where(length2 == 0, 1.0, length2)))
        out = np.minimum(out, (x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2)
    meets = (np.maximum(x1, x2) >= w) & (np.minimum(x1, x2) <= e) & (np.maximum(y1, y2) >= s) & (np.minimum(y1, y2) <= n) & left & right
    return np.where(meets, 0.0, out)
