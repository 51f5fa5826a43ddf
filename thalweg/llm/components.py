"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize

FEW_EDGES = 1_000_000
EDGES_AT_ONCE = 1 << 20


def forest(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components of these edges: every node but the smallest of its component, and that smallest node."""
    ids, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = at[: len(hi)], at[len(hi) :]
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


def contracted(links: DataFrame) -> DataFrame:
    """hi, lo: stars in place of the edges that a task holds, EDGES_AT_ONCE at most at a time; what is connected stays so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= EDGES_AT_ONCE:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    def stars(held: list) -> pa.RecordBatch:
        hi, lo = forest(*map(np.concatenate, zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], ["hi", "lo"])

    return links.select("hi", "lo").mapInArrow(run, "hi long, lo long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) of every node of an edge between different nodes.

    Edges that lie in one task become stars at once. Each round is written to the shared folder, and rounds go on until
    all edges are stars. A star step only takes a node's smallest neighbour, never collecting the
    neighbours: by a window over the edges of the node, or, where there are more edges than one task may well hold, by
    joins that don't send the edges of a hub to one task.
    """
    links = edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).filter("hi <> lo")
    links = materialize(contracted(links).distinct(), "edges")
    while (now := state(links))[1]:
        step = by_joins if now[0] > FEW_EDGES else by_window
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = step(both, "u", "v").filter("v > u").select(F.col("v").alias("hi"), F.least("m", "u").alias("lo")).filter("hi <> lo")
        if step is by_joins:
            large = materialize(large.distinct(), "large-star")
        small = step(large, "hi", "lo").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        links = materialize(contracted(small).distinct(), "small-star")
    return links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def by_window(rows: DataFrame, of: str, to: str) -> DataFrame:
    """rows with m, the smallest `to` of all rows of the same `of`."""
    return rows.withColumn("m", F.min(to).over(Window.partitionBy(of)))


def by_joins(rows: DataFrame, of: str, to: str) -> DataFrame:
    """by_window where a value of `of` may have most rows."""
    return join_hot(rows, rows.groupBy(of).agg(F.min(to).alias("m"), F.count("*").alias("n")), [of], "n").drop("n")


def state(links: DataFrame) -> tuple[int, int]:
    """The number of edges, and of the nodes that keep them from being stars: with two smaller neighbours, or both smaller and larger ones."""
    end = lambda name, up: links.select(F.col(name).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    nodes = end("hi", 1).unionByName(end("lo", 0)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()
    return tuple(row)
