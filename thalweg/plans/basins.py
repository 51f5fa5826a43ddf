"""From the cells of basins to their segments, and on to one network; every basin in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cost_weight, midpoint, probability, water
from ..operators import components, lines, merge, network, paths, skeleton, snapping, spatial
from ..operators.guard import FAILURE, Failures
from ..operators.stencil import CELL, around
from ..sources.tables import cut, fallback_rows, not_done, read_or_empty, write_segments


def watered(cells: DataFrame, at_least: float = 0.5) -> DataFrame:
    """cells (prob_pct, is_ref) with prob, water and the weight of steps."""
    prob = probability(F.col("prob_pct"), F.col("is_ref"))
    return cells.withColumns({"prob": prob, "water": water(prob, at_least), "weight": cost_weight(prob)})


def connected(cells: DataFrame, failures: Failures | None = None) -> DataFrame:
    """kind of every cell after pruning what lies outside, joining lone waters to the river, and the rules on small components."""
    labelled = cut(components.label(watered(cells), failures=failures), "labelled")
    inside = components.prune_outside(labelled).select(*CELL, F.lit(1).alias("inside"))
    pruned = labelled.drop("comp").filter("in_basin").join(inside, CELL, "left").withColumn("water", F.coalesce("inside", F.lit(0))).drop("inside")
    pruned = cut(components.label(pruned, failures=failures), "pruned")
    low = components.lowest_cell(pruned).select(*CELL, F.lit(True).alias("low"))
    merged = components.merge_main(pruned).join(low, CELL, "left").withColumn("low", F.coalesce("low", F.lit(False)))
    return cut(paths.connect_waters(merged, failures=failures), "connected")


def cleaned(kinds: DataFrame, failures: Failures | None = None) -> DataFrame:
    """Small land filled, water thinned, small waters dropped; kind 2 is reference water."""
    flat = components.label(kinds.withColumn("water", (F.col("kind") > 0).cast("int")), failures=failures)
    filled = components.fill_small_land(cut(flat, "flat")).withColumn("kind", F.when(F.col("kind") == 2, 2).otherwise(F.col("water")))
    thin = cut(skeleton.skeleton(filled.select(*CELL, "elev", "kind"), failures), "thin")
    new = components.label(thin.withColumn("water", F.when(F.col("kind") == 1, 1).otherwise(2)), failures=failures)
    kept = components.drop_small_water(cut(new, "thin-labelled"))
    return thin.filter("kind = 2").unionByName(kept.select(*thin.columns))


def reference_flow(vertices: DataFrame) -> DataFrame:
    """basin_id, r, c, to_r, to_c: from each vertex of a basin's reference lines (line_id, pos growing downstream) to the next, null at the mouth."""
    w = Window.partitionBy("basin_id", "line_id").orderBy("pos")
    ahead = vertices.select("basin_id", "r", "c", F.lead(F.struct("r", "c")).over(w).alias("to"), "line_id", "pos")
    last = F.max_by("to", F.when(F.col("to").isNotNull(), F.struct("line_id", "pos")))
    return ahead.groupBy("basin_id", "r", "c").agg(last.alias("to")).select("basin_id", "r", "c", F.col("to.r").alias("to_r"), F.col("to.c").alias("to_c"))


def flow_nodes(thin: DataFrame, flow: DataFrame, failures: Failures | None = None) -> DataFrame:
    """basin_id, node_id, target_id, from_ref, own_order: reference cells flow as their lines do (see reference_flow), others by the flow forest to them."""
    sources = around(thin.withColumn("is_ref", F.col("kind") == 2), [F.lit(0).alias("_n")], ["elev", "kind"]).drop("_n")
    sources = sources.withColumns({"source": F.col("kind") == 2, "weight": F.lit(0.0)})
    forest = paths.flow_forest(sources, failures)
    key = lambda r, c: F.shiftleft(F.col(r).cast("long"), 32) + F.col(c)
    both = thin.join(forest.select(*CELL, "to_r", "to_c"), CELL).join(flow.select(*CELL, F.col("to_r").alias("ref_r"), F.col("to_c").alias("ref_c")), CELL, "left")
    target = F.when(F.col("kind") == 2, F.coalesce(key("ref_r", "ref_c"), F.lit(-1))).otherwise(key("to_r", "to_c"))
    return both.select("basin_id", key("r", "c").alias("node_id"), target.alias("target_id"), (F.col("kind") == 2).alias("from_ref"), F.lit(1).alias("own_order"))


def touching_lines(thin: DataFrame, failures: Failures | None = None) -> DataFrame:
    """basin_id, line_id, pos, x (column), y (row), elev, touches: lines through the new water of thinned cells, and whether a vertex lies beside reference water."""
    beside = around(thin.withColumn("is_ref", F.col("kind") == 2), [F.max(F.when(~F.col("own"), F.col("is_ref")).otherwise(F.lit(False))).alias("touches")], ["elev", "kind"])
    traced = lines.trace(thin.filter("kind = 1"), failures)
    return traced.join(beside.select(*CELL, "elev", "touches"), CELL).select("basin_id", "line_id", "pos", F.col("c").alias("x"), F.col("r").alias("y"), "elev", "touches")


def snapped_nodes(thin: DataFrame, flow: DataFrame, failures: Failures | None = None) -> DataFrame:
    """flow_nodes of lines instead of cells: new lines are traced, snapped to the nearest reference vertex and freed of cycles; reference cells flow as their lines do."""
    key = lambda r, c: F.shiftleft(F.col(r).cast("long"), 32) + F.col(c)
    ref = cut(thin.filter("kind = 2").join(flow.select(*CELL, "to_r", "to_c", F.lit(True).alias("of_line")), CELL, "left"), "reference")
    vertices = ref.filter("of_line").select("basin_id", key("r", "c").alias("vertex_id"), F.col("c").alias("x"), F.col("r").alias("y"), "elev")
    forest = snapping.forest(touching_lines(thin, failures), vertices, failures)
    new = forest.select("basin_id", key("y", "x").alias("node_id"), F.coalesce(key("to_y", "to_x"), F.lit(-1)).alias("target_id"), F.lit(False).alias("from_ref"), F.lit(1).alias("own_order"))
    held = ref.select("basin_id", key("r", "c").alias("node_id"), F.coalesce(key("to_r", "to_c"), F.lit(-1)).alias("target_id"), F.lit(True).alias("from_ref"), F.lit(1).alias("own_order"))
    if failures is not None:  # a basin whose new water broke a kernel must not go on with its reference water alone
        held = held.join(failures.found(thin.sparkSession).select("basin_id"), "basin_id", "left_anti")
    return new.unionByName(held)


def line_of(nodes: str, west: float, north: float, size: float) -> Column:
    """The midpoints of a segment's cells, as an array of structs x, y."""
    return F.transform(nodes, lambda n: midpoint(F.shiftright(n, 32), n.bitwiseAND(F.lit((1 << 32) - 1)), west, north, size))


def basin_segments(cells: DataFrame, flow: DataFrame, failures: Failures | None = None) -> DataFrame:
    """Segments of all basins; basins that break a kernel are noted in failures, if given, and else end the job."""
    thin = cut(cleaned(connected(cells, failures), failures), "cleaned")
    return network.segments(snapped_nodes(thin, flow, failures), failures)


def vector_network(cells: DataFrame, streams: DataFrame, flow: DataFrame, quarantine: str | None = None, west: float = 0.0, north: float = 0.0, size: float = 1.0) -> DataFrame:
    """The whole run: segments of all basins with their lines (WKB), a fallback segment for streams whose basin made none, and their merge.

    streams: stream_id (the basin's), base_order, target_id, us1, us2. The trusted stream stands in for its basin where
    an index went wrong or nothing was found; basins that failed otherwise, in whatever kernel, are left out, and all
    that failed are written to `quarantine` with the kernel and their error.
    """
    failures = Failures()
    made = cut(basin_segments(cells, flow, failures), "segments")
    return merged_network(made, cut(failures.found(cells.sparkSession), "failed"), streams, quarantine, west, north, size)


def merged_network(made: DataFrame, failed: DataFrame, streams: DataFrame, quarantine: str | None = None, west: float = 0.0, north: float = 0.0, size: float = 1.0) -> DataFrame:
    """The network of the segments `made` and of the streams that stand in, given the basins that failed (see vector_network)."""
    if quarantine is not None:
        failed.write.mode("overwrite").parquet(quarantine)
    made = made.withColumn("line", line_of("nodes", west, north, size)).drop("nodes")
    links = streams.select(F.col("stream_id").alias("basin_id"), F.col("target_id").alias("basin_target"), "us1", "us2", "base_order")
    own = made.join(links, "basin_id").withColumn("seg_order", F.when(F.col("from_ref"), F.greatest("seg_order", "base_order")).otherwise(F.col("seg_order"))).drop("base_order")
    lost = failed.filter("error_kind <> 'IndexError'").select("basin_id")
    none = fallback_rows(links.join(lost, "basin_id", "left_anti"), made).select("basin_id", F.lit(0).alias("local_id"), F.lit(-1).alias("local_target"), F.array().cast("array<int>").alias("local_sources"), F.col("base_order").alias("seg_order"), F.lit(True).alias("from_ref"), "basin_target", "us1", "us2")
    none = none.withColumn("line", F.lit(None).cast("array<struct<x:double,y:double>>"))
    merged = merge.merge_network(own.unionByName(none), carry=("line",))
    return merged.withColumn("line", lines.line_wkb("line"))


def resumed_network(cells: DataFrame, streams: DataFrame, flow: DataFrame, regions: DataFrame, folder: str, at_once: int = 16, overwrite: bool = False, **options) -> DataFrame:
    """vector_network in steps of at_once regions (regions: basin_id, region_id), each kept in `folder` as soon as it is done.

    A step writes the segments of its regions, then its failures, then one file that names the regions: as the last of
    the three it makes them count, and a run that is started again takes up the regions that no such file names. What a
    killed run left half-written is replaced, for a region's folder is written as a whole.
    """
    spark = cells.sparkSession
    made, failed, manifest = (f"{folder.rstrip('/')}/{x}" for x in ("segments", "failed", "done"))
    known = spark.createDataFrame([], "region_id long") if overwrite else read_or_empty(spark, manifest, "region_id long")
    left = [r.region_id for r in not_done(regions.select("region_id").distinct(), known, ["region_id"]).orderBy("region_id").collect()]  # regions are few
    for lo in range(0, len(left), at_once):
        step = left[lo : lo + at_once]
        own = cut(regions.filter(F.col("region_id").isin(step)).select("basin_id", F.col("region_id").cast("long").alias("region_id")), "regions")
        of = lambda df: df.join(own.select("basin_id").distinct(), "basin_id", "left_semi")  # noqa: B023, E731
        failures = Failures()
        write_segments(basin_segments(of(cells), of(flow), failures).join(own, "basin_id"), made)
        write_segments(failures.found(spark).join(own, "basin_id"), failed)
        done = spark.createDataFrame([(x,) for x in step], "region_id long").coalesce(1)
        done.write.mode("overwrite" if overwrite and not lo else "append").parquet(manifest)
    every = regions.select(F.col("region_id").cast("long").alias("region_id")).distinct()
    held = read_or_empty(spark, made, network.SEGMENT + ", region_id long").join(every, "region_id", "left_semi").drop("region_id")
    lost = read_or_empty(spark, failed, FAILURE + ", region_id long").join(every, "region_id", "left_semi").drop("region_id")
    wanted = streams.join(regions.select(F.col("basin_id").alias("stream_id")).distinct(), "stream_id", "left_semi")
    return merged_network(held, lost, wanted, **options)


def region_network(cells: DataFrame, streams: DataFrame, flow: DataFrame, places: DataFrame, ring: Column, quarantine: str | None = None) -> DataFrame:
    """vector_network of the basins (places: basin_id, line) that meet the polygon `ring`; region ids come as the rings of scan_regions."""
    wanted = cut(spatial.meeting(places, ring).select("basin_id").distinct(), "wanted")
    of = lambda df: df.join(wanted, "basin_id", "left_semi")
    own = streams.join(wanted.withColumnRenamed("basin_id", "stream_id"), "stream_id", "left_semi")
    return vector_network(of(cells), own, of(flow), quarantine)


def traced(cells: DataFrame) -> DataFrame:
    return lines.trace(cleaned(connected(cells)))
