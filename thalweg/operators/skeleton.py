"""Thinning of water to lines, highest cells first."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.cells import BIT, CORNERS, FORKS, OPPOSITE, SIDES, STEPS
from .guard import Failures, per_basin


def removable(mask: int) -> bool:
    """What functions.cells.removal_class calls a candidate, for one mask."""
    on = lambda n: bool(mask & BIT[n])
    sides = [n for n in SIDES if on(n)]
    if len(sides) == 3:
        return True
    if len(sides) == 2:
        return set(sides) not in ({"N", "S"}, {"E", "W"}) and not any(all(map(on, f)) for f in FORKS)
    if len(sides) == 1:
        return any(map(on, CORNERS)) and not any(on(s) and any(map(on, OPPOSITE[s])) for s in SIDES)
    return False


def joined_without(mask: int) -> bool:
    """Whether the neighbours in the mask are connected with each other, so that the middle may go."""
    cells = [STEPS[n] for n in STEPS if mask & BIT[n]]
    if not cells:
        return False
    reached, todo = {cells[0]}, [cells[0]]
    while todo:
        r, c = todo.pop()
        for x in cells:
            if x not in reached and max(abs(x[0] - r), abs(x[1] - c)) == 1:
                reached.add(x)
                todo.append(x)
    return len(reached) == len(cells)


SIMPLE = [removable(m) and joined_without(m) for m in range(256)]


def thin_cells(cells: dict[tuple[int, int], tuple[int, int]]) -> set[tuple[int, int]]:
    """The cells (row, column -> elevation, kind) that stay. Reference water (kind 2) always does.

    A generation of removable cells is taken from the highest down (ties by row and column) and tested again when its
    turn comes; neighbours that a removal lays bare make the next generation.
    """
    left = set(cells)
    mask = lambda x: sum(BIT[n] for n, (dr, dc) in STEPS.items() if (x[0] + dr, x[1] + dc) in left)
    bare = {x for x, (_, kind) in cells.items() if kind == 1 and SIMPLE[mask(x)]}
    while bare:
        heap = [(-cells[x][0], *x) for x in bare]
        heapq.heapify(heap)
        bare = set()
        while heap:
            _, r, c = heapq.heappop(heap)
            if SIMPLE[mask((r, c))]:
                left.discard((r, c))
                bare |= {x for dr, dc in STEPS.values() if (x := (r + dr, c + dc)) in left and cells[x][1] == 1}
        bare = {x for x in bare if x in left and SIMPLE[mask(x)]}
    return left


def skeleton(cells: DataFrame, failures: Failures | None = None) -> DataFrame:
    """Cells of kind 1 and 2 that thinning leaves, per basin; the number of connected waters does not change."""

    def run(basin: pd.DataFrame) -> pd.DataFrame:
        held = {(r, c): (e, k) for r, c, e, k in basin[["r", "c", "elev", "kind"]].itertuples(index=False) if k > 0}
        left = thin_cells(held)
        return basin[[(r, c) in left for r, c in zip(basin["r"], basin["c"], strict=True)]][["basin_id", "r", "c", "elev", "kind"]]

    return per_basin(cells.filter("kind > 0"), run, "basin_id long, r int, c int, elev int, kind int", failures, "thin")
