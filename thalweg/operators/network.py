"""Flow topology: vertices to nodes, nodes to segments, stream orders."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .guard import Failures, per_basin


def flow_links(vertices: DataFrame, line: str = "line_id", keep: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Each vertex with the place of the vertex before and behind it (-1: none). Lines run downstream."""
    w = Window.partitionBy(line).orderBy("pos")
    return vertices.select(line, "pos", *keep, F.coalesce(F.lag("pos").over(w), F.lit(-1)).alias("source_pos"), F.coalesce(F.lead("pos").over(w), F.lit(-1)).alias("target_pos"))


def shared_nodes(vertices: DataFrame, line: str = "line_id") -> DataFrame:
    """x, y, from_ref, own_order, n_sources, tx, ty of every place where lines have a vertex: a node of the flow.

    vertices: line, pos, x, y, from_ref, own_order, pos growing downstream. Where lines share a vertex, its target is
    that of the last line that goes on from there (reference lines come first, then by line), its sources are all
    different places before it, and it is reference water if any of its lines is.
    """
    w = Window.partitionBy(line).orderBy("pos")
    near = vertices.select(line, "pos", "x", "y", "from_ref", "own_order", F.lead(F.struct("x", "y")).over(w).alias("to"), F.lag(F.struct("x", "y")).over(w).alias("source"))
    last = F.when(F.col("to").isNotNull(), F.struct((~F.col("from_ref")).cast("int").alias("kind"), line, "pos"))
    order = F.max(F.when(F.col("from_ref"), F.col("own_order")))
    out = near.groupBy("x", "y").agg(F.max("from_ref").alias("from_ref"), F.coalesce(order, F.lit(1)).alias("own_order"), F.size(F.collect_set("source")).cast("long").alias("n_sources"), F.max_by("to", last).alias("to"))
    return out.select("x", "y", "from_ref", "own_order", "n_sources", F.col("to.x").alias("tx"), F.col("to.y").alias("ty"))


def vertex_graph(vertices: DataFrame, line: str = "line_id") -> DataFrame:
    """line, pos, to_pos, cost: both directions of every step of a line; a step costs what it descends."""
    w = Window.partitionBy(line).orderBy("pos")
    ahead = vertices.select(line, "pos", "elev", F.lead("pos").over(w).alias("to_pos"), F.lead("elev").over(w).alias("to_elev")).filter("to_pos IS NOT NULL")
    down = ahead.select(line, "pos", "to_pos", F.greatest(F.lit(0), F.col("elev") - F.col("to_elev")).alias("cost"))
    return down.unionByName(ahead.select(line, F.col("to_pos").alias("pos"), F.col("pos").alias("to_pos"), F.greatest(F.lit(0), F.col("to_elev") - F.col("elev")).alias("cost")))


def downstream(vertices: DataFrame, line: str = "line_id") -> DataFrame:
    """Lines that are stored from mouth to source, turned round."""
    last = Window.partitionBy(line)
    return vertices.withColumn("pos", (F.max("pos").over(last) - F.col("pos")).cast("int"))


def heads(nodes: DataFrame, node: str = "stream_id", target: str = "target_id") -> DataFrame:
    """Nodes that nothing flows into."""
    return nodes.join(nodes.select(F.col(target).alias(node)).distinct(), node, "left_anti")


def strahler(orders: Column) -> Column:
    """Order below sources of these orders (an array): the largest, one more if it is there twice; 0 of none."""
    most = F.coalesce(F.array_max(orders), F.lit(0))
    return most + F.when(F.size(F.filter(orders, lambda o: o == most)) > 1, 1).otherwise(0)


def strahler_of(orders: list[int]) -> int:
    most = max(orders, default=0)
    return most + (orders.count(most) > 1)


def topological(targets: dict[int, int]) -> list[int]:
    """Nodes after all of their sources; nodes on and below cycles are left out."""
    waiting = defaultdict(int)
    for t in targets.values():
        waiting[t] += 1
    ready, out = sorted((n for n in targets if not waiting[n]), reverse=True), []
    while ready:
        n = ready.pop()
        out.append(n)
        t = targets[n]
        waiting[t] -= 1
        if t in targets and not waiting[t]:
            ready.append(t)
    return out


def segments_of(targets: dict[int, int], from_ref: dict[int, bool], own: dict[int, int]) -> list[dict]:
    """Segments of one basin: each runs from a node where water rises, meets or changes origin to the next such node, which it includes."""
    sources = defaultdict(list)
    for n in sorted(targets):
        if targets[n] in targets:
            sources[targets[n]].append(n)
    order, sequence = dict(own), topological(targets)
    for n in sequence:
        order[n] = max(own[n], strahler_of([order[s] for s in sources[n]]))
    breaks = lambda n: len(sources[n]) != 1 or from_ref[sources[n][0]] != from_ref[n]
    out, starting, ending = [], {}, defaultdict(list)
    for n in sequence:
        if breaks(n) and targets[n] in targets:
            nodes = [n, targets[n]]
            while not breaks(nodes[-1]) and targets[nodes[-1]] in targets:
                nodes.append(targets[nodes[-1]])
            starting[n] = len(out)
            ending[nodes[-1]].append(len(out))
            out.append({"local_id": len(out), "nodes": nodes, "from_ref": all(from_ref[x] for x in nodes), "seg_order": order[n]})
    for s in out:
        s["local_target"] = starting.get(s["nodes"][-1], -1)
        s["local_sources"] = ending[s["nodes"][0]]
    return out


SEGMENT = "basin_id long, local_id int, local_target int, local_sources array<int>, seg_order int, from_ref boolean, nodes array<long>"


def segments(nodes: DataFrame, failures: Failures | None = None) -> DataFrame:
    """Segments of every basin from nodes (basin_id, node_id, target_id, from_ref, own_order); target -1: none. One task holds one basin."""

    def run(basin: pd.DataFrame) -> pd.DataFrame:
        ids = basin["node_id"].tolist()
        found = segments_of(dict(zip(ids, basin["target_id"].tolist(), strict=True)), dict(zip(ids, basin["from_ref"].tolist(), strict=True)), dict(zip(ids, basin["own_order"].tolist(), strict=True)))
        frame = pd.DataFrame(found, columns=["local_id", "local_target", "local_sources", "seg_order", "from_ref", "nodes"])
        return frame.assign(basin_id=basin["basin_id"].iloc[0])[[x.split()[0] for x in SEGMENT.split(", ")]]

    return per_basin(nodes, run, SEGMENT, failures, "segments")
