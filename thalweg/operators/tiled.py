"""Labels and distances over grids of any size: kernels run tile by tile, and what crosses the seams is joined.

A task holds some tiles of basins at a time (one, if it is large), however large a basin is; kernels take them together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import SIDES, STEPS
from ..sources.tables import cut
from .graphs import connected
from .grids import EIGHT, FOUR, links, roots
from .lots import by_lots, changes
from .paths import BARRED, CUTOFFS

TILE = 512
PLACE = ["basin_id", "r", "c"]


def tile_of(cell: str, tile: int) -> Column:
    return F.floor(F.col(cell) / tile).cast("int")


def at_seam(tile: int) -> Column:
    """Whether a cell lies at a side of its tile."""
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    return edge("r") | edge("c")


def across(cells: DataFrame, tile: int) -> DataFrame:
    """Cells at seams, once for each neighbouring place r2, c2 in another tile; corner says whether it is a diagonal neighbour."""
    step = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(n not in SIDES).alias("corner")) for n, (dr, dc) in STEPS.items())))
    out = cells.filter(at_seam(tile)).withColumn("s", step).withColumns({"r2": F.col("r") + F.col("s.dr"), "c2": F.col("c") + F.col("s.dc"), "corner": F.col("s.corner")}).drop("s")
    return out.filter((tile_of("r", tile) != tile_of("r2", tile)) | (tile_of("c", tile) != tile_of("c2", tile)))


def label(cells: DataFrame, kind: str = "water", as_: str = "comp", tile: int = TILE) -> DataFrame:
    """cells with the labels of components.label: 1, 2, .. of water (kind 1), -1, -2, .. of land (kind 0), in row-major order of first cells; other kinds get 0."""
    held = cells.select(*(c for c in cells.columns if c != as_))
    own = held.columns
    keys = ["basin_id", "_tr", "_tc"]

    def run(part: pa.Table) -> pa.Table:
        r, c, of = (part.column(k).to_numpy() for k in ("r", "c", kind))
        group = np.cumsum(changes(part, keys))
        row, col = group * (tile + 1) + r % tile, c % tile  # tiles below each other, a row apart
        first = np.full(len(part), -1)
        for value, steps in ((1, EIGHT), (0, FOUR)):
            at = np.flatnonzero(of == value)
            first[at] = at[roots(len(at), *links(row[at], col[at], steps))]
        least = lambda x: pa.array(np.where(first >= 0, x[first], 0).astype(np.int32))
        return part.select(own).append_column("_r0", least(r)).append_column("_c0", least(c)).append_column("_known", pa.array(first >= 0))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema), "_r0 int, _c0 int, _known boolean"])
    tiles = held.withColumns({"_tr": tile_of("r", tile), "_tc": tile_of("c", tile)})
    local = cut(by_lots(tiles, keys, ["r", "c"], run, schema), "tile-labels")
    known = local.filter("_known").withColumn("_node", F.struct("basin_id", "_r0", "_c0", F.col(kind).cast("int").alias("kind")))
    edge = known.filter(at_seam(tile)).select(*PLACE, F.col("_node.kind").alias("kind"), F.col("_node").alias("a"))
    there = edge.select("basin_id", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("kind").alias("kind2"), F.col("a").alias("b"))
    edges = across(edge, tile).join(there, ["basin_id", "r2", "c2"]).filter("kind = kind2 AND (kind = 1 OR NOT corner)").select("a", "b").distinct()
    joined = connected(edges)
    nodes = known.select(F.col("_node").alias("node")).distinct().join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    places = nodes.select("root").distinct().withColumn("n", F.row_number().over(Window.partitionBy("root.basin_id", "root.kind").orderBy("root._r0", "root._c0")))
    named = nodes.join(places, "root").select(F.col("node").alias("_node"), F.when(F.col("root.kind") == 1, F.col("n")).otherwise(-F.col("n")).cast("long").alias("_label"))
    labelled = known.join(named, "_node").select(*own, F.col("_label").alias(as_))
    return labelled.unionByName(local.filter("NOT _known").select(*own, F.lit(0).cast("long").alias(as_)))


def relaxed(near: np.ndarray, cost: np.ndarray, dist: np.ndarray, active: np.ndarray, cutoff: float) -> np.ndarray:
    """dist after all ways from the active nodes: node i reaches node near[i, k] at cost[i, k] (inf: it does not).

    Adding costs of 0 or more keeps the order of distances, so every node gets the least sum of a way, as in paths.Grid.distances.
    """
    dist = dist.copy()
    while len(active):
        total, to = dist[active, None] + cost[active], near[active]
        nearer = (total <= cutoff) & (total < dist[to])
        np.minimum.at(dist, to[nearer], total[nearer])
        active = np.unique(to[nearer])
    return dist


def step_costs(row: np.ndarray, col: np.ndarray, elev: np.ndarray, weight: np.ndarray, descent: bool) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each cell, in eight columns, and what a step to them costs, as in paths.Grid; inf where there is none."""
    near, cost = np.zeros((len(row), 8), np.int64), np.full((len(row), 8), np.inf)
    for k, step in enumerate(EIGHT):
        a, b = links(row, col, (step,))
        for slot, u, v in ((k, a, b), (k + 4, b, a)):
            drop = np.fmax(0.0, elev[u] - elev[v])
            near[u, slot] = v
            cost[u, slot] = drop if descent else np.where(drop > 20, BARRED, np.where(drop > 0, np.maximum(weight[u] * drop, drop), np.maximum(weight[u], 0.0)))
    return near, cost


def bounded_distances(nodes: DataFrame, cutoff: float = CUTOFFS[0], tile: int = TILE, descent: bool = False) -> DataFrame:
    """basin_id, r, c, dist of the nodes within the cutoff of a source, as paths.bounded_distances has them (descent: only what a step descends counts).

    In each round the tiles whose surroundings have come nearer to a source are relaxed from the cells around them, and
    cells at seams that came nearer wake the tiles beside them. Rounds are as many as the tiles that a shortest way crosses.
    A round is one shuffle of the cells; tiles that nothing has woken pass it as they are.
    """
    inf = float("inf")
    held = nodes.select(*PLACE, F.col("elev").cast("double").alias("elev"), F.col("weight").cast("double").alias("weight"), F.when(F.col("source"), 0.0).otherwise(inf).alias("dist"))
    held = held.withColumns({"tr": tile_of("r", tile), "tc": tile_of("c", tile)})
    held = cut(held.withColumn("nearer", F.col("dist") == 0), "tiled")
    schema = "basin_id long, r int, c int, elev double, weight double, dist double, tr int, tc int, nearer boolean"
    names, keys = [x.split()[0] for x in schema.split(", ")], ["basin_id", "tr", "tc"]

    def of_round(first: bool):
        def run(part: pa.Table) -> pa.Table:
            r, c, elev, weight, before, tr, tc, around = (part.column(k).to_numpy() for k in ("r", "c", "elev", "weight", "dist", "tr", "tc", "around"))
            start = changes(part, keys)
            group = np.cumsum(start) - 1
            awake = np.logical_or.reduceat(around | (first & np.isfinite(before)), np.flatnonzero(start))[group]
            dist = before.copy()
            at = np.flatnonzero(awake)
            # tiles below each other, with the cells around them and a row apart
            near, cost = step_costs(group[at] * (tile + 3) + r[at] - tr[at].astype(np.int64) * tile, c[at] - tc[at].astype(np.int64) * tile, elev[at], weight[at], descent)
            begin = np.isfinite(before[at]) if first else around[at]
            dist[at] = relaxed(near, cost, before[at], np.flatnonzero(begin), cutoff)
            out = part.set_column(part.schema.get_field_index("dist"), "dist", pa.array(dist))
            out = out.set_column(out.schema.get_field_index("nearer"), "nearer", pa.array(dist < before))
            return out.select(names).filter(pa.array(~around))

        return run

    first, left = True, held.filter("nearer")
    while not left.isEmpty():
        woken = across(held.filter("nearer"), tile).select("basin_id", "r", "c", "elev", "weight", "dist", tile_of("r2", tile).alias("tr"), tile_of("c2", tile).alias("tc"), "nearer").distinct()
        rows = held.withColumn("around", F.lit(False)).unionByName(woken.withColumn("around", F.lit(True)))
        held = cut(by_lots(rows, keys, ["r", "c"], of_round(first), schema), "tiled")
        first, left = False, across(held.filter("nearer"), tile)
    return held.filter(F.col("dist") < inf).select(*PLACE, "dist")
