"""Bounded shortest paths over cells, flow forests, and the connection of lone waters to the river."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import STEPS, step_cost
from .grids import links
from .guard import Failures, per_basin

CUTOFFS = (8.0, 32.0, 400.0)
BARRED = 1e30


def edges(nodes: DataFrame) -> DataFrame:
    """basin_id, r, c, r2, c2, cost of every step between neighbours among nodes (basin_id, r, c, weight, elev)."""
    to = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in STEPS.values()]))
    out = nodes.select("basin_id", "r", "c", "weight", "elev", to.alias("to")).withColumns({"r2": F.col("r") + F.col("to.dr"), "c2": F.col("c") + F.col("to.dc")})
    there = nodes.select("basin_id", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("elev").alias("elev2"))
    return out.join(there, ["basin_id", "r2", "c2"]).select("basin_id", "r", "c", "r2", "c2", step_cost(F.col("weight"), F.col("elev"), F.col("elev2")).alias("cost"))


class Grid:
    """Neighbours and step costs of one basin's nodes."""

    def __init__(self, r, c, elev, weight):
        self.elev, self.weight, self.near = elev.astype(float).tolist(), weight.astype(float).tolist(), [[] for _ in r]
        for i, j in zip(*(x.tolist() for x in links(r, c)), strict=True):
            self.near[i].append(j)
            self.near[j].append(i)

    def cost(self, u: int, v: int) -> float:
        drop = max(0.0, self.elev[u] - self.elev[v])
        if drop > 20:
            return BARRED
        return max(self.weight[u] * drop, drop) if drop else max(self.weight[u], 0.0)

    def descent(self, u: int, v: int) -> float:
        return max(0.0, self.elev[u] - self.elev[v])

    def distances(self, sources, cost, cutoff: float = BARRED / 2, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distance to the nearest source (inf beyond the cutoff) and the next node towards it (-1 at a source); ties by index.

        start says how far the sources are from where ways begin; without it they are the beginnings.
        """
        near, dist, parent, over = self.near, [float("inf")] * len(self.near), [-1] * len(self.near), bytearray(len(self.near))
        for s in sources:
            dist[s] = 0.0 if start is None else float(start[s])
        heap = sorted((dist[s], int(s)) for s in sources)
        while heap:
            d, u = heapq.heappop(heap)
            if over[u]:
                continue
            over[u] = 1
            for v in near[u]:
                if over[v]:  # costs are 0 or more, so nothing nearer is left for it
                    continue
                total = d + cost(u, v)
                if total <= cutoff and total < dist[v]:
                    dist[v], parent[v] = total, u
                    heapq.heappush(heap, (total, v))
        return np.array(dist, float), np.array(parent, int)


def grid_of(basin: pd.DataFrame) -> Grid:
    return Grid(basin["r"].to_numpy(), basin["c"].to_numpy(), basin["elev"].to_numpy(), basin["weight"].to_numpy())


def bounded_distances(nodes: DataFrame, cutoff: float = CUTOFFS[0]) -> DataFrame:
    """basin_id, r, c, dist of the nodes that lie within the cutoff of a source (column source)."""

    def run(basin: pd.DataFrame) -> pd.DataFrame:
        basin = basin.sort_values(["r", "c"], ignore_index=True)
        grid = grid_of(basin)
        dist, _ = grid.distances(np.flatnonzero(basin["source"]), grid.cost, cutoff)
        return basin[["basin_id", "r", "c"]].assign(dist=dist)[np.isfinite(dist)]

    return nodes.groupBy("basin_id").applyInPandas(run, "basin_id long, r int, c int, dist double")


def flow_forest(nodes: DataFrame, failures: Failures | None = None) -> DataFrame:
    """basin_id, r, c, dist, to_r, to_c: the way of least descent from the sources; every reached node has one next node, so cycles are gone."""

    def run(basin: pd.DataFrame) -> pd.DataFrame:
        basin = basin.sort_values(["r", "c"], ignore_index=True)
        grid = grid_of(basin)
        dist, parent = grid.distances(np.flatnonzero(basin["source"]), grid.descent)
        to = lambda k: pd.array(np.where(parent >= 0, basin[k].to_numpy()[parent], -1), dtype="int32")
        return basin[["basin_id", "r", "c"]].assign(dist=dist, to_r=to("r"), to_c=to("c"))[np.isfinite(dist)]

    return per_basin(nodes, run, "basin_id long, r int, c int, dist double, to_r int, to_c int", failures, "forest")


def rounds(basin: pd.DataFrame, cutoffs: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, set[int], np.ndarray]:
    """Nodes, their components, the components joined to the main one, and the nodes on ways, after the rounds of all cutoffs."""
    comp, main = basin["comp"].to_numpy(), int(basin["main"].iloc[0])
    node = np.flatnonzero((basin["prob"].to_numpy() > 0.1) | (comp > 0))
    sub = basin.iloc[node].reset_index(drop=True)
    grid, own = grid_of(sub), comp[node]
    low = {int(own[i]): i for i in np.flatnonzero(sub["low"].to_numpy() & (own > 0))}
    joined = {main}
    way = np.zeros(len(node), bool)
    for cutoff in cutoffs:
        dist, parent = grid.distances(np.flatnonzero(np.isin(own, list(joined)) | way), grid.cost, cutoff)
        found = []
        for k, i in low.items():
            if k not in joined and np.isfinite(dist[i]):
                path = [i]
                while parent[path[-1]] >= 0:
                    path.append(int(parent[path[-1]]))
                found.append((len(path), k, path))
        for _, k, path in sorted(found):
            for i in path:
                if own[i] in joined or way[i]:
                    break
                way[i] = True
                grid.weight[i] = 0.0
            joined.add(k)
    return node, own, joined, way


def connect_waters(cells: DataFrame, cutoffs: tuple[float, ...] = CUTOFFS, failures: Failures | None = None) -> DataFrame:
    """kind of every cell: 2 reference water, 1 connected water and the ways that connect it, 0 the rest.

    cells: basin_id, r, c, elev, weight, prob, comp (label, water > 0), main, is_ref, low (the lowest cell of a component).
    In each round of growing cutoffs the components whose lowest cell is reached are joined, nearest in cells first; a
    way's cells become part of the river and cost nothing from then on. Basins without a main component stay as they are.
    """

    def run(basin: pd.DataFrame) -> pd.DataFrame:
        basin = basin.sort_values(["r", "c"], ignore_index=True)
        kind = (basin["comp"].to_numpy() > 0).astype(np.int32)
        if int(basin["main"].iloc[0]) > 0:
            node, own, joined, way = rounds(basin, cutoffs)
            kept = np.isin(own, list(joined)) | way
            kind[:] = 0
            kind[node[kept]] = 1
        kind[basin["is_ref"].to_numpy()] = 2
        return basin[["basin_id", "r", "c", "elev", "in_basin"]].assign(kind=kind)

    return per_basin(cells, run, "basin_id long, r int, c int, elev int, in_basin boolean, kind int", failures, "connect")


def unseen_components(cells: DataFrame, cutoffs: tuple[float, ...] = CUTOFFS) -> DataFrame:
    """basin_id, comp of the components that no round of connect_waters joins; without a main component, of all."""

    def run(basin: pd.DataFrame) -> pd.DataFrame:
        basin = basin.sort_values(["r", "c"], ignore_index=True)
        comp = basin["comp"].to_numpy()
        seen = rounds(basin, cutoffs)[2] if int(basin["main"].iloc[0]) > 0 else set()
        left = sorted({int(k) for k in comp[comp > 0]} - seen)
        return pd.DataFrame({"basin_id": np.full(len(left), basin["basin_id"].iloc[0], np.int64), "comp": np.array(left, np.int32)})

    return cells.groupBy("basin_id").applyInPandas(run, "basin_id long, comp int")
