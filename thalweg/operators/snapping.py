"""New lines joined to reference water, and the cycles among them removed."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .guard import Failures, per_basin
from .lines import nearest_places, snap_points

LINE = ["basin_id", "line_id"]
PLACE = ["basin_id", "x", "y"]
FOREST = "basin_id long, x long, y long, to_x long, to_y long, snapped boolean, dist double"


def kept_lines(vertices: DataFrame) -> DataFrame:
    """The vertices of lines that do not touch reference water at both ends, and which of them snaps (see lines.snap_points)."""
    rule = snap_points(vertices, LINE).filter("action <> 'drop'").select(*LINE, F.when(F.col("action") == "snap", F.col("pos")).alias("at"))
    return vertices.join(rule, LINE).withColumn("snaps", F.coalesce(F.col("pos") == F.col("at"), F.lit(False))).drop("at")


def snapped(kept: DataFrame, reference: DataFrame) -> DataFrame:
    """basin_id, x, y, to_x, to_y, cost: the places that snap, each with the nearest reference vertex of its basin (of several that of the smallest identifier).

    cost is what the connecting line descends from the reference vertex (basin_id, vertex_id, x, y, elev) to the place.
    """
    places = kept.filter("snaps").groupBy(*PLACE).agg(F.max("elev").alias("elev"))
    at = reference.groupBy("basin_id", F.col("x").alias("to_x"), F.col("y").alias("to_y")).agg(F.min(F.struct("vertex_id", "elev")).alias("v"))
    near = nearest_places(places, reference, "basin_id").withColumnsRenamed({"vx": "to_x", "vy": "to_y"}).join(at.hint("merge"), ["basin_id", "to_x", "to_y"])
    first = near.groupBy(*PLACE).agg(F.min(F.struct("v", "to_x", "to_y")).alias("n")).select(*PLACE, "n.to_x", "n.to_y", F.col("n.v.elev").alias("to_elev"))
    out = first.join(places, PLACE)
    return out.select(*PLACE, "to_x", "to_y", F.greatest(F.lit(0), F.col("to_elev") - F.col("elev")).cast("double").alias("cost"))


def grow(edges: dict[tuple, list[tuple[tuple, float]]], starts: dict[tuple, float]) -> dict[tuple, tuple[float, tuple | None]]:
    """Distance of every place that can be reached from the starts, and the next place on the way back (None at a start); ties by place."""
    best: dict[tuple, tuple[float, tuple | None]] = {p: (d, None) for p, d in starts.items()}
    heap, over = sorted((d, p) for p, d in starts.items()), set()
    while heap:
        d, p = heapq.heappop(heap)
        if p in over:
            continue
        over.add(p)
        for q, cost in edges.get(p, ()):
            if q not in best or d + cost < best[q][0]:
                best[q] = d + cost, p
                heapq.heappush(heap, (d + cost, q))
    return best


def forest(vertices: DataFrame, reference: DataFrame, failures: Failures | None = None) -> DataFrame:
    """basin_id, x, y, to_x, to_y, snapped, dist: where the water of every place of the new lines flows.

    vertices: basin_id, line_id, pos, x, y, elev, touches; reference: basin_id, vertex_id, x, y, elev, all places whole
    numbers. Lines that touch reference water at both ends go. From the snapped places ways run out over the other lines,
    a step costing what it descends, and every place flows back along the least costly: nothing runs in a circle, and
    what no way reaches goes. A basin in which nothing snaps keeps its lines as they run, from first to last vertex.
    """
    kept = cut(kept_lines(vertices), "kept-lines")
    joined = cut(snapped(kept, reference), "snapped")
    ahead = lambda c: F.lead(c).over(Window.partitionBy(*LINE).orderBy("pos"))
    steps = kept.select(*PLACE, "line_id", "pos", "elev", ahead("x").alias("to_x"), ahead("y").alias("to_y"), ahead("elev").alias("to_elev"))
    none = F.lit(None).cast("long")
    steps = steps.select("basin_id", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "to_x", "to_y")), (F.col("elev") - F.col("to_elev")).cast("double").alias("drop"), "line_id", "pos")
    # lines over one another make a step many times; the last of those from a place says where it flows, if nothing snaps
    steps = steps.groupBy(*PLACE, "to_x", "to_y", "drop").agg(F.max(F.struct("line_id", "pos")).alias("l"))
    steps = steps.select(*PLACE, "to_x", "to_y", "drop", "l.line_id", "l.pos", F.lit(False).alias("start"))
    starts = joined.select("basin_id", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "to_x", "to_y")), F.col("cost").alias("drop"), none.alias("line_id"), none.alias("pos"), F.lit(True).alias("start"))

    def run(basin: pd.DataFrame) -> pd.DataFrame:
        basin_id, rows = basin["basin_id"].iloc[0], basin.sort_values(["line_id", "pos", "x", "y"], kind="stable")
        whole = lambda x: None if pd.isna(x) else int(x)
        edges, own, starts, ends = defaultdict(list), {}, {}, {}
        for x, y, tx, ty, drop, start in zip(*(rows[c].tolist() for c in ("x", "y", "to_x", "to_y", "drop", "start")), strict=True):
            here, to = (int(x), int(y)), None if whole(tx) is None else (int(tx), int(ty))
            if start:
                starts[here], ends[here] = drop, to
            elif to is None:
                own.setdefault(here, None)
            else:
                own[here] = to
                edges[here].append((to, max(drop, 0.0)))
                edges[to].append((here, max(-drop, 0.0)))
        if starts:
            out = [(*p, *(back or ends[p]), back is None, d) for p, (d, back) in sorted(grow(edges, starts).items())]
        else:
            out = [(*p, *(to or (None, None)), False, None) for p, to in sorted(own.items())]
        frame = pd.DataFrame(out, columns=["x", "y", "to_x", "to_y", "snapped", "dist"]).astype({"to_x": "Int64", "to_y": "Int64", "dist": "float64"})
        return frame.assign(basin_id=basin_id)[["basin_id", "x", "y", "to_x", "to_y", "snapped", "dist"]]

    return per_basin(steps.unionByName(starts), run, FOREST, failures, "snap")
