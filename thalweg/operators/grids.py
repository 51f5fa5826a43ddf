"""Arrays of one basin's cells, for the grouped kernels. A basin's grid is bounded by the drainage area it stands for."""

from __future__ import annotations

import numpy as np

EIGHT = ((0, 1), (1, -1), (1, 0), (1, 1))
FOUR = ((0, 1), (1, 0))


def links(r: np.ndarray, c: np.ndarray, steps=EIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indexes of cells that are neighbours by one of the steps (half of the directions)."""
    if not len(r):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = int(c.max() - c.min()) + 3
    key = (r - r.min()).astype(np.int64) * width + (c - c.min() + 1)
    order = np.argsort(key)
    held = key[order]
    a, b = [], []
    for dr, dc in steps:
        at = np.minimum(np.searchsorted(held, key + dr * width + dc), len(held) - 1)
        hit = np.flatnonzero(held[at] == key + dr * width + dc)
        a.append(hit)
        b.append(order[at[hit]])
    return np.concatenate(a), np.concatenate(b)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index connected to each of n nodes, by least neighbours and pointer jumps."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        np.minimum.at(new, root[a], root[b])
        np.minimum.at(new, root[b], root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def component_labels(r: np.ndarray, c: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Labels in row-major order of each component's first cell: 1, 2, .. of water (kind 1, eight neighbours), -1, -2, ..
    of land (kind 0, four neighbours); other kinds get 0."""
    out = np.zeros(len(r), np.int64)
    order = np.lexsort((c, r))
    for value, steps, sign in ((1, EIGHT, 1), (0, FOUR, -1)):
        own = order[kind[order] == value]
        root = roots(len(own), *links(r[own], c[own], steps))
        out[own] = sign * (np.unique(root, return_inverse=True)[1] + 1)
    return out
