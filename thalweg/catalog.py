"""One query for each operator over the bridge views, with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells as fc
from .operators import components, lines, merge, network, noding, paths, skeleton, snapping, spatial, stencil, tiled
from .plans import basins
from .sources import tables
from .sources.bridge import load, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CELL = ["basin_id", "r", "c"]
SYSTEM_LEVELS = 24

#: CTEs that several statements share.
WATERED = """, w AS MATERIALIZED (SELECT *, CASE WHEN is_ref THEN 1.0 ELSE prob_pct / 100.0 END AS prob, CAST(is_ref OR prob_pct >= 50 AS INT) AS water FROM b_cells_masked)"""
STEP8 = ", s8 AS (SELECT * FROM (VALUES (-1,0,1,1),(0,1,2,1),(1,0,4,1),(0,-1,8,1),(-1,1,16,0),(1,1,32,0),(1,-1,64,0),(-1,-1,128,0)) t(dr,dc,bit,side))"
MASK = WATERED + STEP8 + """, m AS MATERIALIZED (
SELECT x.basin_id, x.r, x.c, x.water, CAST(COALESCE(SUM(CASE WHEN y.water = 1 THEN bit END), 0) AS INT) AS mask
FROM w x CROSS JOIN s8 LEFT JOIN w y ON y.basin_id = x.basin_id AND y.r = x.r + dr AND y.c = x.c + dc GROUP BY ALL)"""


def labels(name: str, source: str, where: str, sides_only: bool = False) -> str:
    """A recursive CTE: the least row-major place of each cell's component."""
    near = "abs(a.r - b.r) + abs(a.c - b.c) = 1" if sides_only else "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1"
    return f""", {name} AS (
SELECT basin_id, r, c, r * 32 + c AS root FROM {source} WHERE {where}
UNION
SELECT b.basin_id, b.r, b.c, MIN(a.root) AS root FROM {name} a JOIN recurring.{name} b ON a.basin_id = b.basin_id AND {near} AND a.root < b.root GROUP BY b.basin_id, b.r, b.c)"""


def keyed(sql: str, *names: str) -> str:
    for n in names:
        sql = sql.replace(f", {n} AS (\nSELECT", f", {n}(basin_id, r, c, root) USING KEY (basin_id, r, c) AS (\nSELECT", 1)
    return sql


WATER_LABELS = WATERED + keyed(labels("wl", "w", "water = 1"), "wl") + ", comp AS MATERIALIZED (SELECT *, DENSE_RANK() OVER (PARTITION BY basin_id ORDER BY root) AS comp FROM wl)"
LAND_LABELS = WATERED + keyed(labels("ll", "w", "water = 0", True), "ll") + ", land AS MATERIALIZED (SELECT *, -DENSE_RANK() OVER (PARTITION BY basin_id ORDER BY root) AS comp FROM ll)"
LOWEST = STEP8 + """, mean AS (SELECT x.basin_id, x.r, x.c, x.in_basin, AVG(y.elev) AS mean_elev FROM w x JOIN w y ON x.basin_id = y.basin_id AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 GROUP BY ALL),
low AS (SELECT basin_id, comp, r, c, in_basin FROM mean JOIN comp USING (basin_id, r, c) QUALIFY ROW_NUMBER() OVER (PARTITION BY basin_id, comp ORDER BY mean_elev, r, c) = 1)"""
MAIN = ", main AS (SELECT basin_id, COALESCE(MIN(CASE WHEN is_ref THEN comp END), -1) AS main FROM w LEFT JOIN comp USING (basin_id, r, c) GROUP BY basin_id)"
WEIGHT = "CASE WHEN prob <= 0.1 OR prob >= 0.5 THEN 0.0 ELSE -log2((prob - 0.1) / (0.5 - 0.1)) END"
COST = "CASE WHEN u.elev - v.elev > 20 THEN 1e30 WHEN v.elev >= u.elev THEN greatest(u.weight, 0.0) ELSE greatest(u.weight * (u.elev - v.elev), CAST(u.elev - v.elev AS DOUBLE)) END"
EDGES = f""", nodes AS MATERIALIZED (SELECT *, {WEIGHT} AS weight FROM w WHERE prob > 0.1 OR water = 1),
edges AS MATERIALIZED (SELECT u.basin_id, u.r, u.c, v.r AS r2, v.c AS c2, {COST} AS cost FROM nodes u JOIN nodes v ON u.basin_id = v.basin_id AND abs(u.r - v.r) <= 1 AND abs(u.c - v.c) <= 1 AND (u.r <> v.r OR u.c <> v.c))"""
DIST = EDGES + """, dist(basin_id, r, c, d) USING KEY (basin_id, r, c) AS (
SELECT basin_id, r, c, 0.0::DOUBLE AS d FROM nodes WHERE is_ref
UNION
SELECT e.basin_id, e.r2, e.c2, MIN(x.d + e.cost) AS d FROM dist x JOIN edges e ON e.basin_id = x.basin_id AND e.r = x.r AND e.c = x.c
LEFT JOIN recurring.dist y ON y.basin_id = e.basin_id AND y.r = e.r2 AND y.c = e.c2 WHERE x.d + e.cost <= 8 AND (y.d IS NULL OR x.d + e.cost < y.d) GROUP BY e.basin_id, e.r2, e.c2)"""
NUMBERED = """, seg AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (ORDER BY basin_id, local_id) - 1 AS seg_id FROM b_segments),
src AS MATERIALIZED (SELECT s.*, COALESCE(l.sources, []) AS local_sources FROM seg s LEFT JOIN (SELECT basin_id, local_target, list(local_id ORDER BY local_id) AS sources FROM seg WHERE local_target >= 0 GROUP BY ALL) l ON l.basin_id = s.basin_id AND l.local_target = s.local_id),
flagged AS MATERIALIZED (SELECT *, from_ref AND local_target = -1 AND basin_target <> -1 AS leaves, from_ref AND len(local_sources) = 0 AND us1 <> -1 AS enters FROM src),
ends AS MATERIALIZED (SELECT basin_id, MAX(CASE WHEN enters THEN seg_id END) AS entry_id, MAX(CASE WHEN leaves THEN seg_id END) AS exit_id FROM flagged GROUP BY basin_id)"""
TARGETS = """, targets AS (SELECT f.seg_id, COALESCE(CASE WHEN f.leaves THEN e.entry_id ELSE l.seg_id END, -1) AS target_seg
FROM flagged f LEFT JOIN ends e ON e.basin_id = f.basin_target LEFT JOIN seg l ON l.basin_id = f.basin_id AND l.local_id = f.local_target)"""
SOURCES = """, upper AS (SELECT seg_id, basin_id, enters, CASE WHEN enters THEN [us1, us2] ELSE CAST(local_sources AS BIGINT[]) END AS ups FROM flagged),
each AS (SELECT seg_id, basin_id, enters, unnest(ups) AS up, generate_subscripts(ups, 1) AS pos FROM upper),
sources AS (SELECT u.seg_id, COALESCE(string_agg(CAST(COALESCE(CASE WHEN x.enters THEN e.exit_id ELSE l.seg_id END, -1) AS VARCHAR), ',' ORDER BY x.pos) FILTER (WHERE x.pos IS NOT NULL), '') AS source_segs
FROM upper u LEFT JOIN each x ON x.seg_id = u.seg_id LEFT JOIN ends e ON x.enters AND e.basin_id = x.up LEFT JOIN seg l ON NOT x.enters AND l.basin_id = x.basin_id AND l.local_id = x.up GROUP BY u.seg_id)"""


def leveled(rule: str, start: str) -> str:
    """Orders of b_streams by levels, unrolled."""
    out = f", l0 AS MATERIALIZED (SELECT stream_id, base_order, us1, us2, {start} AS o FROM b_streams)"
    for i in range(1, SYSTEM_LEVELS + 1):
        out += f""",
l{i} AS MATERIALIZED (SELECT x.stream_id, x.base_order, x.us1, x.us2, COALESCE(x.o, CASE WHEN (a.stream_id IS NULL OR a.o IS NOT NULL) AND (b.stream_id IS NULL OR b.o IS NOT NULL) THEN {rule} END) AS o
FROM l{i - 1} x LEFT JOIN l{i - 1} a ON a.stream_id = x.us1 LEFT JOIN l{i - 1} b ON b.stream_id = x.us2)"""
    return out


REPAIR = leveled("CASE WHEN a.o IS NULL OR b.o IS NULL THEN greatest(x.base_order, COALESCE(a.o, 0), COALESCE(b.o, 0)) WHEN a.o = b.o THEN greatest(x.base_order, a.o + 1) ELSE greatest(x.base_order, a.o, b.o) END", "CASE WHEN us1 = -1 THEN base_order END")
STRAHLER = leveled("CASE WHEN a.o = b.o THEN a.o + 1 ELSE greatest(1, COALESCE(a.o, 0), COALESCE(b.o, 0)) END", "CASE WHEN us1 = -1 THEN 1 END")


def query(oracle: str | None = None, *views: str, recursive: bool = False):
    def held(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = with_views(oracle, *views, recursive=recursive)
        return f

    return held


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.watered(load(spark, sf_dir, "b_cells_masked"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.label(masked(spark, sf_dir).select(*CELL, "elev", "is_ref", "in_basin", "water"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cut(merge.global_ids(merge.with_sources(load(spark, sf_dir, "b_segments"))), "numbered")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.reference_flow(load(spark, sf_dir, "b_ref_cells"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir).filter("prob > 0.1 OR water = 1").withColumn("source", F.col("is_ref"))


@query(WATERED + " SELECT basin_id, COUNT(*) AS n_cells, CAST(SUM(water) AS BIGINT) AS n_water, AVG(water) > 0.25 AS wet FROM w GROUP BY basin_id", "b_cells_masked")
def water_threshold(spark, sf_dir):
    return masked(spark, sf_dir).groupBy("basin_id").agg(F.count("*").alias("n_cells"), F.sum("water").alias("n_water"), (F.avg("water") > 0.25).alias("wet"))


@query(WATERED + f" SELECT basin_id, r, c, round({WEIGHT}, 6) AS weight FROM w", "b_cells_masked")
def cell_cost_weight(spark, sf_dir):
    return masked(spark, sf_dir).select(*CELL, F.round("weight", 6).alias("weight"))


@query(" SELECT bbox_id, tile_id FROM b_bboxes b JOIN b_tiles t ON b.w - 0.01 <= t.e AND t.w <= b.e + 0.01 AND b.s - 0.01 <= t.n AND t.s <= b.n + 0.01", "b_tiles", "b_bboxes")
def bbox_buffer_tiles(spark, sf_dir):
    box = lambda by: F.struct((F.col("w") - by).alias("w"), (F.col("s") - by).alias("s"), (F.col("e") + by).alias("e"), (F.col("n") + by).alias("n"))
    return spatial.box_join(load(spark, sf_dir, "b_bboxes").select("bbox_id", box(0.01).alias("a")), load(spark, sf_dir, "b_tiles").select("tile_id", box(0.0).alias("b")), 1.0).select("bbox_id", "tile_id")


@query(" SELECT tile_id, w, s, e, n FROM b_tiles", "b_tiles")
def tile_boxes(spark, sf_dir):
    name = F.concat_ws("_", F.lit("tile"), "w", "s", "e", "n")
    return load(spark, sf_dir, "b_tiles").select("tile_id", tables.tile_box(F.concat(name, F.lit(".tif"))).alias("b")).select("tile_id", "b.*")


@query(" SELECT r, c, arg_min(prob_pct, basin_id) AS prob_pct FROM b_cells WHERE r BETWEEN 4 AND 27 AND c BETWEEN 4 AND 27 GROUP BY r, c", "b_cells")
def tile_mosaic_first(spark, sf_dir):
    return tables.mosaic(load(spark, sf_dir, "b_cells").filter("r BETWEEN 4 AND 27 AND c BETWEEN 4 AND 27"), ["r", "c"], "prob_pct", "basin_id")


@query(MASK + " SELECT basin_id, r, c, CAST(bit_count(mask) AS BIGINT) AS n FROM m", "b_cells_masked")
def neighbour_count_8(spark, sf_dir):
    return stencil.neighbour_count(masked(spark, sf_dir), "water", []).select(*CELL, "n")


@query(MASK + " SELECT basin_id, r, c, CAST(bit_count(mask & 15) AS BIGINT) AS n FROM m", "b_cells_masked")
def neighbour_count_4(spark, sf_dir):
    return stencil.neighbour_count(masked(spark, sf_dir), "water", [], sides_only=True).select(*CELL, "n")


@query(WATERED + " SELECT x.basin_id, x.r, x.c, round(AVG(y.elev), 6) AS mean_elev FROM w x JOIN w y ON x.basin_id = y.basin_id AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 GROUP BY ALL", "b_cells_masked")
def mean_elev_3x3(spark, sf_dir):
    return stencil.mean_elevation(masked(spark, sf_dir), []).withColumn("mean_elev", F.round("mean_elev", 6))


@query(WATERED + " SELECT DISTINCT x.basin_id, x.r, x.c FROM w x JOIN w y ON x.basin_id = y.basin_id AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 WHERE y.is_ref AND x.water = 1 AND NOT x.is_ref", "b_cells_masked")
def touching_reference(spark, sf_dir):
    return stencil.touching(masked(spark, sf_dir), []).select(*CELL)


FORK = "((mask & 28) = 28 OR (mask & 41) = 41 OR (mask & 67) = 67 OR (mask & 134) = 134)"
BENT = "((mask & 1 = 1 AND mask & 96 > 0) OR (mask & 2 = 2 AND mask & 192 > 0) OR (mask & 4 = 4 AND mask & 144 > 0) OR (mask & 8 = 8 AND mask & 48 > 0))"


@query(MASK + f" SELECT basin_id, r, c, {FORK} AS fork, {BENT} AS bent FROM m WHERE water = 1", "b_cells_masked")
def junction_patterns(spark, sf_dir):
    m = stencil.neighbour_mask(masked(spark, sf_dir), "water", ["water"]).filter("water = 1")
    return m.select(*CELL, fc.is_fork(F.col("mask")).alias("fork"), fc.is_bent_end(F.col("mask")).alias("bent"))


@query(MASK + f""" SELECT basin_id, r, c, CASE bit_count(mask & 15) WHEN 4 THEN 'interior' WHEN 3 THEN 'candidate'
WHEN 2 THEN CASE WHEN (mask & 15) IN (5, 10) OR {FORK} THEN 'keep' ELSE 'candidate' END
WHEN 1 THEN CASE WHEN mask & 240 > 0 AND NOT {BENT} THEN 'candidate' ELSE 'keep' END ELSE 'keep' END AS class FROM m WHERE water = 1""", "b_cells_masked")  # fmt: skip
def thin_candidates(spark, sf_dir):
    m = stencil.neighbour_mask(masked(spark, sf_dir), "water", ["water"]).filter("water = 1")
    return m.select(*CELL, fc.removal_class(F.col("mask")).alias("class"))


@query(WATER_LABELS + " SELECT basin_id, r, c, comp FROM comp", "b_cells_masked", recursive=True)
def water_components(spark, sf_dir):
    return labelled(spark, sf_dir).filter("comp > 0").select(*CELL, "comp")


@query(LAND_LABELS + " SELECT basin_id, r, c, comp FROM land", "b_cells_masked", recursive=True)
def land_components(spark, sf_dir):
    return labelled(spark, sf_dir).filter("comp < 0").select(*CELL, "comp")


@query(WATER_LABELS + LAND_LABELS.removeprefix(WATERED) + " SELECT basin_id, r, c, comp FROM comp UNION ALL SELECT basin_id, r, c, comp FROM land", "b_cells_masked", recursive=True)
def tiled_components(spark, sf_dir):
    return tiled.label(masked(spark, sf_dir).select(*CELL, "water"), tile=8).select(*CELL, "comp")


@query(WATER_LABELS + " SELECT basin_id, comp, COUNT(*) AS n_cells, CAST(MAX(elev) - MIN(elev) AS BIGINT) AS elev_range FROM comp JOIN w USING (basin_id, r, c) GROUP BY basin_id, comp", "b_cells_masked", recursive=True)
def component_stats(spark, sf_dir):
    return components.stats(labelled(spark, sf_dir).filter("comp > 0"))


@query(WATER_LABELS + MAIN + " SELECT basin_id, main FROM main", "b_cells_masked", recursive=True)
def main_component(spark, sf_dir):
    return components.main_component(labelled(spark, sf_dir))


@query(WATER_LABELS + LOWEST + " SELECT basin_id, comp, r, c, in_basin FROM low", "b_cells_masked", recursive=True)
def component_lowest_cell(spark, sf_dir):
    return components.lowest_cell(tables.cut(labelled(spark, sf_dir), "labelled"))


@query(WATER_LABELS + LOWEST + MAIN + """, kept AS (SELECT basin_id, comp FROM comp JOIN w USING (basin_id, r, c) JOIN main USING (basin_id) JOIN (SELECT basin_id, comp, in_basin AS low_inside FROM low) USING (basin_id, comp)
GROUP BY basin_id, comp, main, low_inside HAVING comp = main OR AVG(CAST(in_basin AS INT)) > 0.75 OR low_inside)
SELECT basin_id, r, c FROM comp JOIN w USING (basin_id, r, c) JOIN kept USING (basin_id, comp) WHERE in_basin""", "b_cells_masked", recursive=True)  # fmt: skip
def out_of_basin_prune(spark, sf_dir):
    return components.prune_outside(tables.cut(labelled(spark, sf_dir), "labelled")).select(*CELL)


@query(LAND_LABELS + """, filled AS (SELECT basin_id, comp FROM land JOIN w USING (basin_id, r, c) GROUP BY basin_id, comp HAVING COUNT(*) < 20 OR (COUNT(*) < 400 AND MAX(elev) - MIN(elev) < 4))
SELECT w.basin_id, w.r, w.c, CASE WHEN f.comp IS NOT NULL THEN 1 ELSE w.water END AS water FROM w LEFT JOIN land USING (basin_id, r, c) LEFT JOIN filled f ON f.basin_id = land.basin_id AND f.comp = land.comp""", "b_cells_masked", recursive=True)  # fmt: skip
def fill_small_land(spark, sf_dir):
    return components.fill_small_land(tables.cut(labelled(spark, sf_dir), "labelled")).select(*CELL, "water")


@query(WATERED + keyed(labels("nl", "w", "water = 1 AND NOT is_ref"), "nl") + " SELECT basin_id, r, c FROM nl QUALIFY COUNT(*) OVER (PARTITION BY basin_id, root) >= 8", "b_cells_masked", recursive=True)
def drop_small_water(spark, sf_dir):
    cells = masked(spark, sf_dir).select(*CELL, F.when(F.col("is_ref"), 2).otherwise(F.col("water")).alias("water"))
    return components.drop_small_water(tables.cut(components.label(cells), "labelled")).select(*CELL)


@query(WATERED + EDGES + " SELECT basin_id, r, c, r2, c2, round(cost, 6) AS cost FROM edges", "b_cells_masked")
def cell_edges(spark, sf_dir):
    return paths.edges(nodes(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


@query(WATERED + DIST + " SELECT basin_id, r, c, round(d, 6) AS dist FROM dist", "b_cells_masked", recursive=True)
def bounded_paths_dist(spark, sf_dir):
    return paths.bounded_distances(nodes(spark, sf_dir)).withColumn("dist", F.round("dist", 6))


@query(WATERED + DIST.replace("<= 8 ", "<= 32 ") + " SELECT basin_id, r, c, round(d, 6) AS dist FROM dist", "b_cells_masked", recursive=True)
def bounded_paths_dist_32(spark, sf_dir):
    return paths.bounded_distances(nodes(spark, sf_dir), paths.CUTOFFS[1]).withColumn("dist", F.round("dist", 6))


@query(WATERED + DIST.replace("<= 8 ", "<= 400 ") + " SELECT basin_id, r, c, round(d, 6) AS dist FROM dist", "b_cells_masked", recursive=True)
def bounded_paths_dist_400(spark, sf_dir):
    return paths.bounded_distances(nodes(spark, sf_dir), paths.CUTOFFS[2]).withColumn("dist", F.round("dist", 6))


@query(WATERED + DIST.replace("<= 8 ", "<= 32 ") + " SELECT basin_id, r, c, round(d, 6) AS dist FROM dist", "b_cells_masked", recursive=True)
def tiled_paths_dist(spark, sf_dir):
    return tiled.bounded_distances(nodes(spark, sf_dir), paths.CUTOFFS[1], tile=16).withColumn("dist", F.round("dist", 6))


@query(WATERED + DIST.replace(COST, "CAST(greatest(0, u.elev - v.elev) AS DOUBLE)").replace("prob > 0.1 OR water = 1", "water = 1").replace("x.d + e.cost <= 8 AND ", "") + " SELECT basin_id, r, c, d AS dist FROM dist", "b_cells_masked", recursive=True)
def path_forest_dist(spark, sf_dir):
    return paths.flow_forest(nodes(spark, sf_dir).filter("water = 1")).select(*CELL, "dist")


@query()
def unseen_components(spark, sf_dir):
    """Over ground eight times as steep, where barred steps leave waters that no round reaches."""
    held = tables.cut(components.label(masked(spark, sf_dir).withColumn("elev", F.col("elev") * 8)), "labelled")
    low = components.lowest_cell(held).select(*CELL, F.lit(True).alias("low"))
    return paths.unseen_components(components.merge_main(held).join(low, CELL, "left").withColumn("low", F.coalesce("low", F.lit(False))))


@query()
def connect_components(spark, sf_dir):
    return basins.connected(load(spark, sf_dir, "b_cells_masked")).select(*CELL, "kind")


@query()
def skeleton_cells(spark, sf_dir):
    kinds = masked(spark, sf_dir).select(*CELL, "elev", F.when(F.col("is_ref"), 2).otherwise(F.col("water")).alias("kind"))
    return skeleton.skeleton(kinds)


@query()
def trace_lines(spark, sf_dir):
    return basins.traced(load(spark, sf_dir, "b_cells_masked"))


@query()
def basin_pipeline(spark, sf_dir):
    return basins.basin_segments(load(spark, sf_dir, "b_cells_masked"), reference(spark, sf_dir)).withColumn("nodes", F.size("nodes"))


@query()
def vector_network(spark, sf_dir):
    cells = load(spark, sf_dir, "b_cells_masked")
    return basins.vector_network(cells, load(spark, sf_dir, "b_streams"), reference(spark, sf_dir))


@query()
def region_network(spark, sf_dir):
    cells = load(spark, sf_dir, "b_cells_masked")
    places = cells.groupBy("basin_id").agg(F.array(F.struct((F.col("basin_id") % 50).cast("double").alias("x"), (F.col("basin_id") * 7 % 50).cast("double").alias("y"))).alias("line"))
    return basins.region_network(cells, load(spark, sf_dir, "b_streams"), reference(spark, sf_dir), places, ring_column())


@query(" SELECT line_id, pos, x, y, COALESCE(LAG(pos) OVER w, -1) AS source_pos, COALESCE(LEAD(pos) OVER w, -1) AS target_pos FROM (SELECT line_id, CAST(MAX(pos) OVER (PARTITION BY line_id) - pos AS INT) AS pos, x, y FROM b_line_vertices) WINDOW w AS (PARTITION BY line_id ORDER BY pos)", "b_line_vertices")
def line_vertices(spark, sf_dir):
    return network.flow_links(network.downstream(load(spark, sf_dir, "b_line_vertices")))


@query(" SELECT stream_id, base_order FROM b_streams WHERE stream_id NOT IN (SELECT target_id FROM b_streams)", "b_streams")
def network_heads(spark, sf_dir):
    return network.heads(load(spark, sf_dir, "b_streams")).select("stream_id", "base_order")


@query(STRAHLER + f" SELECT stream_id, CAST(o AS INT) AS strahler FROM l{SYSTEM_LEVELS}", "b_streams")
def strahler_fold(spark, sf_dir):
    return merge.strahler_orders(load(spark, sf_dir, "b_streams"))


CHAINS = """, v AS (SELECT line_id, pos, x < 40 AS from_ref, MAX(pos) OVER (PARTITION BY line_id) AS last FROM b_line_vertices),
starts AS (SELECT line_id, pos, last, LEAD(pos) OVER (PARTITION BY line_id ORDER BY pos) AS next_start FROM (SELECT *, LAG(from_ref) OVER (PARTITION BY line_id ORDER BY pos) AS before FROM v) WHERE before IS NULL OR before <> from_ref),
seg AS (SELECT s.line_id, s.pos AS first_pos, COALESCE(s.next_start, s.last) AS last_pos, s.next_start IS NULL OR s.next_start = s.last AS ends FROM starts s WHERE COALESCE(s.next_start, s.last) > s.pos)"""


@query(CHAINS + " SELECT s.line_id, s.first_pos, s.last_pos, bool_and(v.from_ref) AS from_ref FROM seg s JOIN v ON v.line_id = s.line_id AND v.pos BETWEEN s.first_pos AND s.last_pos GROUP BY ALL", "b_line_vertices")
def chain_segments(spark, sf_dir):
    return line_segments(spark, sf_dir).select("line_id", "first_pos", "last_pos", "from_ref")


@query(CHAINS + " SELECT a.line_id, a.first_pos, COALESCE(b.first_pos, -1) AS target_first, COALESCE(p.first_pos, -1) AS source_first FROM seg a LEFT JOIN seg b ON b.line_id = a.line_id AND b.first_pos = a.last_pos LEFT JOIN seg p ON p.line_id = a.line_id AND p.last_pos = a.first_pos", "b_line_vertices")
def segment_links(spark, sf_dir):
    held = tables.cut(line_segments(spark, sf_dir), "segments")
    # shuffled: a small file of segments may still be many rows for a task to hold
    first = held.select("line_id", F.col("local_id").alias("other"), F.col("first_pos").alias("other_first"))
    out = held.join(first.select("line_id", F.col("other").alias("local_target"), F.col("other_first").alias("target_first")).hint("merge"), ["line_id", "local_target"], "left")
    out = out.withColumn("source", F.coalesce(F.get("local_sources", F.lit(0)), F.lit(-1))).join(first.select("line_id", F.col("other").alias("source"), F.col("other_first").alias("source_first")).hint("merge"), ["line_id", "source"], "left")
    return out.select("line_id", "first_pos", F.coalesce("target_first", F.lit(-1)).cast("int").alias("target_first"), F.coalesce("source_first", F.lit(-1)).cast("int").alias("source_first"))


def line_segments(spark, sf_dir):
    v = network.flow_links(load(spark, sf_dir, "b_line_vertices"))
    found = network.segments(v.select(F.col("line_id").alias("basin_id"), F.col("pos").cast("long").alias("node_id"), F.col("target_pos").cast("long").alias("target_id"), (F.col("x") < 40).alias("from_ref"), F.lit(1).alias("own_order")))
    return found.withColumnRenamed("basin_id", "line_id").withColumns({"first_pos": F.get("nodes", F.lit(0)).cast("int"), "last_pos": F.element_at("nodes", -1).cast("int")})


TOUCH = "(x * 5 + y) % 11 = 0"


@query(f""", v AS (SELECT line_id, pos, {TOUCH} AS t, MAX(pos) OVER (PARTITION BY line_id) AS last FROM b_line_vertices),
a AS (SELECT line_id, COUNT(*) AS n_vertices, MAX(last) AS last, bool_or(t AND pos = 0) AS head, bool_or(t AND pos = last) AS tail, MIN(CASE WHEN t THEN pos END) AS first FROM v GROUP BY line_id)
SELECT line_id, n_vertices, CASE WHEN head AND tail THEN 'drop' WHEN first IS NOT NULL THEN 'snap' ELSE 'none' END AS action, CAST(CASE WHEN head AND tail THEN NULL WHEN head THEN 0 WHEN tail THEN last ELSE first END AS INT) AS pos FROM a""", "b_line_vertices")  # fmt: skip
def snap_rule(spark, sf_dir):
    return lines.snap_points(load(spark, sf_dir, "b_line_vertices").withColumn("touches", F.expr(TOUCH)), ["line_id"])


@query(" SELECT grp, point_id, vertex_id, dist2 FROM (SELECT p.grp, point_id, vertex_id, CAST((p.x - v.x) * (p.x - v.x) + (p.y - v.y) * (p.y - v.y) AS BIGINT) AS dist2 FROM b_points p JOIN b_ref_vertices v ON p.grp = v.grp) QUALIFY RANK() OVER (PARTITION BY point_id ORDER BY dist2) = 1", "b_points", "b_ref_vertices")
def nearest_vertex(spark, sf_dir):
    return lines.nearest_vertices(load(spark, sf_dir, "b_points"), load(spark, sf_dir, "b_ref_vertices"))


@query(" SELECT line_id, pos, x, y, FALSE AS from_ref FROM b_line_vertices WHERE line_id % 3 <> 0 UNION ALL SELECT line_id, pos, x, y, TRUE FROM b_line_vertices WHERE line_id % 3 = 0", "b_line_vertices")
def union_flagged_lines(spark, sf_dir):
    v = load(spark, sf_dir, "b_line_vertices")
    return lines.with_reference(v.filter("line_id % 3 <> 0"), v.filter("line_id % 3 = 0"))


#: A closed ring with a notch, for the query of points in a polygon.
RING = ((5.5, 5.5), (40.5, 8.5), (44.5, 38.5), (25.5, 20.5), (9.5, 42.5), (5.5, 5.5))
SIDES = ", sides AS (SELECT * FROM (VALUES " + ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(RING, RING[1:])) + ") t(x1, y1, x2, y2))"


def ring_column():
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])


@query(SIDES + " SELECT point_id, COUNT(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / NULLIF(y2 - y1, 0) + x1) % 2 = 1 AS inside FROM b_points CROSS JOIN sides GROUP BY point_id", "b_points")
def point_in_polygon(spark, sf_dir):
    return spatial.inside_polygon(load(spark, sf_dir, "b_points"), F.col("x"), F.col("y"), ring_column()).select("point_id", "inside")


@query(", grid AS (SELECT r AS gx, c AS gy, MAX(elev) AS elev FROM b_cells GROUP BY r, c) SELECT point_id, elev FROM b_points LEFT JOIN grid ON gx = CAST(floor(x / 2.0) AS INT) AND gy = CAST(floor(y / 2.0) AS INT)", "b_points", "b_cells")
def elevation_sample(spark, sf_dir):
    grid = load(spark, sf_dir, "b_cells").groupBy(F.col("r").alias("gx"), F.col("c").alias("gy")).agg(F.max("elev").alias("elev"))
    return spatial.sample_grid(load(spark, sf_dir, "b_points"), grid, 2.0).select("point_id", "elev")


@query(" SELECT stream_id, base_order FROM b_streams WHERE stream_id NOT IN (SELECT basin_id FROM b_segments WHERE basin_id % 3 = 0)", "b_segments")
def resume_anti_join(spark, sf_dir):
    done = load(spark, sf_dir, "b_segments").filter("basin_id % 3 = 0").select(F.col("basin_id").alias("stream_id"))
    return tables.not_done(load(spark, sf_dir, "b_streams"), done, ["stream_id"]).select("stream_id", "base_order")


@query(" SELECT stream_id AS basin_id, target_id, base_order FROM b_streams WHERE stream_id NOT IN (SELECT basin_id FROM b_segments WHERE seg_order > 1)", "b_segments")
def fallback_rows(spark, sf_dir):
    streams = load(spark, sf_dir, "b_streams").select(F.col("stream_id").alias("basin_id"), "target_id", "base_order")
    return tables.fallback_rows(streams, load(spark, sf_dir, "b_segments").filter("seg_order > 1"))


@query(" SELECT stream_id, CASE WHEN us1 = -1 THEN '' ELSE concat(us1, ',', us2) END AS sources FROM b_streams", "b_streams")
def upstream_lists(spark, sf_dir):
    ups = F.when(F.col("us1") != -1, F.array("us1", "us2")).otherwise(F.array().cast("array<bigint>"))
    return load(spark, sf_dir, "b_streams").select("stream_id", F.array_join(ups.cast("array<string>"), ",").alias("sources"))


@query(" SELECT stream_id, part_id, part_no, area FROM b_basin_candidates QUALIFY ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY area DESC, part_id, part_no) = 1", "b_basin_candidates")
def dedupe_largest_basin(spark, sf_dir):
    return merge.largest_basin(load(spark, sf_dir, "b_basin_candidates"))


@query(" SELECT COALESCE(g.basin_id, s.stream_id) AS stream_id, CAST(g.max_order AS INT) AS max_order, s.target_id FROM (SELECT basin_id, MAX(seg_order) AS max_order FROM b_segments GROUP BY basin_id) g FULL OUTER JOIN b_streams s ON g.basin_id = s.stream_id", "b_segments")
def basin_max_order(spark, sf_dir):
    return merge.basin_max_orders(load(spark, sf_dir, "b_segments"), load(spark, sf_dir, "b_streams"))


@query(REPAIR + f" SELECT stream_id, CAST(COALESCE(o, base_order) AS INT) AS repaired FROM l{SYSTEM_LEVELS}", "b_streams")
def order_repair(spark, sf_dir):
    return merge.repair_orders(load(spark, sf_dir, "b_streams"))


@query(NUMBERED + " SELECT basin_id, local_id, seg_id FROM seg", "b_segments")
def global_ids(spark, sf_dir):
    return merge.global_ids(load(spark, sf_dir, "b_segments")).select("basin_id", "local_id", "seg_id")


@query(NUMBERED + " SELECT basin_id, entry_id, exit_id FROM ends", "b_segments")
def entry_exit_segments(spark, sf_dir):
    return merge.basin_ends(numbered(spark, sf_dir))


@query(NUMBERED + TARGETS + " SELECT seg_id, target_seg FROM targets", "b_segments")
def remap_targets(spark, sf_dir):
    return merge.global_targets(numbered(spark, sf_dir))


@query(NUMBERED + SOURCES + " SELECT seg_id, source_segs FROM sources", "b_segments")
def remap_sources(spark, sf_dir):
    return merge.global_sources(numbered(spark, sf_dir)).withColumn("source_segs", F.array_join(F.col("source_segs").cast("array<string>"), ","))


@query(NUMBERED + TARGETS + SOURCES + REPAIR + f""" SELECT s.seg_id AS stream_id, t.target_seg AS target_stream_id, u.source_segs AS source_stream_ids,
CAST(CASE WHEN s.from_ref THEN greatest(s.seg_order, COALESCE(l.o, l.base_order, 1)) ELSE s.seg_order END AS INT) AS stream_order, s.from_ref, s.basin_id
FROM seg s JOIN targets t USING (seg_id) JOIN sources u USING (seg_id) LEFT JOIN l{SYSTEM_LEVELS} l ON l.stream_id = s.basin_id""", "b_segments")  # fmt: skip
def merge_network(spark, sf_dir):
    out = merge.merge_network(load(spark, sf_dir, "b_segments"))
    return out.withColumn("source_stream_ids", F.array_join(F.col("source_stream_ids").cast("array<string>"), ","))


def line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "b_line_vertices").withColumn("p", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    return v.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("v")).select("line_id", F.col("v.p").alias("line"))


STEPS_SQL = ", steps AS (SELECT line_id, pos, x AS x1, y AS y1, LEAD(x) OVER w AS x2, LEAD(y) OVER w AS y2 FROM b_line_vertices WINDOW w AS (PARTITION BY line_id ORDER BY pos))"


@query(SIDES + STEPS_SQL + """, inside AS (SELECT DISTINCT line_id FROM (SELECT line_id, pos, COUNT(*) FILTER (WHERE (b.y1 > v.y) <> (b.y2 > v.y) AND v.x < (b.x2 - b.x1) * (v.y - b.y1) / NULLIF(b.y2 - b.y1, 0) + b.x1) % 2 = 1 AS i FROM b_line_vertices v CROSS JOIN sides b GROUP BY line_id, pos) WHERE i),
across AS (SELECT DISTINCT line_id FROM steps a CROSS JOIN sides b WHERE a.x2 IS NOT NULL
AND sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0),
long AS (SELECT line_id FROM steps WHERE x2 IS NOT NULL GROUP BY line_id HAVING SUM(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) > 0)
SELECT line_id, COUNT(*) AS n_vertices FROM b_line_vertices WHERE line_id IN (SELECT line_id FROM inside UNION SELECT line_id FROM across) AND line_id IN (SELECT line_id FROM long) GROUP BY line_id""", "b_line_vertices")  # fmt: skip
def masked_lines(spark, sf_dir):
    found = spatial.meeting(tables.with_length(line_arrays(spark, sf_dir)), ring_column())
    return found.select("line_id", F.size("line").cast("long").alias("n_vertices"))


@query(""", cropped AS (SELECT basin_id, r, c, prob_pct FROM b_cells WHERE r BETWEEN 10 AND 13 AND c BETWEEN 10 AND 12 AND prob_pct < 90),
inside AS (SELECT basin_id FROM b_cells WHERE r BETWEEN 10 AND 13 AND c BETWEEN 10 AND 12 GROUP BY basin_id HAVING MIN(r) < MAX(r) AND MIN(c) < MAX(c)),
first AS (SELECT r, c, arg_min(prob_pct, basin_id) AS prob_pct FROM cropped WHERE basin_id IN (SELECT basin_id FROM inside) GROUP BY r, c)
SELECT CAST(a.r AS INT) AS r, CAST(b.c AS INT) AS c, COALESCE(prob_pct, 0) AS prob_pct FROM (SELECT unnest(range(10, 14)) AS r) a CROSS JOIN (SELECT unnest(range(10, 13)) AS c) b LEFT JOIN first f ON f.r = a.r AND f.c = b.c""", "b_cells")  # fmt: skip
def box_raster(spark, sf_dir):
    return tables.box_raster(load(spark, sf_dir, "b_cells"), "basin_id", "prob_pct", (10, 13, 10, 12), nodata=90)


@query(" SELECT s.stream_id, s.target_id, b.part_id, b.part_no, b.area FROM b_streams s JOIN (SELECT * FROM b_basin_candidates QUALIFY ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY area DESC, part_id, part_no) = 1) b USING (stream_id)", "b_streams", "b_basin_candidates")
def streams_with_basins(spark, sf_dir):
    return merge.streams_with_basins(load(spark, sf_dir, "b_streams").select("stream_id", "target_id"), load(spark, sf_dir, "b_basin_candidates"))


@query(", lines AS (SELECT line_id, line_id % 10 AS multi, COUNT(*) AS n_vertices FROM b_line_vertices GROUP BY line_id) SELECT multi, CAST(ROW_NUMBER() OVER (PARTITION BY multi ORDER BY line_id) - 1 AS INT) AS part, n_vertices FROM lines", "b_line_vertices")
def single_lines(spark, sf_dir):
    held = line_arrays(spark, sf_dir).groupBy((F.col("line_id") % 10).alias("multi")).agg(F.sort_array(F.collect_list(F.struct("line_id", "line"))).alias("l")).select("multi", F.col("l.line").alias("parts"))
    return lines.single_lines(held, "multi").select("multi", "part", F.size("line").cast("long").alias("n_vertices"))


@query(" SELECT line_id, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM b_line_vertices", "b_line_vertices")
def reference_vertices(spark, sf_dir):
    return lines.vertices_of(line_arrays(spark, sf_dir))


TO_BOX = "pow(greatest(gx * 4.0 - {x}, 0, {x} - gx * 4.0 - 4), 2) + pow(greatest(gy * 4.0 - {y}, 0, {y} - gy * 4.0 - 4), 2)"
SPOT = "least(1.0, greatest(0.0, CASE WHEN x1 = x2 AND y1 = y2 THEN 0.0 ELSE (({x} - x1) * (x2 - x1) + ({y} - y1) * (y2 - y1)) / CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE) END))"
TO_STEP = "pow({x} - (x1 + " + SPOT + " * (x2 - x1)), 2) + pow({y} - (y1 + " + SPOT + " * (y2 - y1)), 2)"
CORNERS = [("gx * 4.0", "gy * 4.0"), ("(gx * 4.0 + 4)", "gy * 4.0"), ("gx * 4.0", "(gy * 4.0 + 4)"), ("(gx * 4.0 + 4)", "(gy * 4.0 + 4)")]
SIGNS = ", ".join(f"sign((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1))" for x, y in CORNERS)


@query(STEPS_SQL + f""", near AS (SELECT s.*, gx, gy FROM steps s, (SELECT unnest(range(-1, 17)) AS gx) a, (SELECT unnest(range(-1, 17)) AS gy) b WHERE x2 IS NOT NULL)
SELECT DISTINCT line_id, CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy FROM near
WHERE (greatest(x1, x2) >= gx * 4 AND least(x1, x2) <= gx * 4 + 4 AND greatest(y1, y2) >= gy * 4 AND least(y1, y2) <= gy * 4 + 4 AND least({SIGNS}) <= 0 AND greatest({SIGNS}) >= 0)
OR least({TO_BOX.format(x="x1", y="y1")}, {TO_BOX.format(x="x2", y="y2")}, {", ".join(TO_STEP.format(x=x, y=y) for x, y in CORNERS)}) <= 0.25""", "b_line_vertices")  # fmt: skip
def touched_cells(spark, sf_dir):
    steps = noding.line_steps(load(spark, sf_dir, "b_line_vertices")).filter("x2 IS NOT NULL")
    return spatial.touched_cells(steps, 4.0, 0.5, key=["line_id"])


@query(" SELECT basin_id, r, c, CAST(CASE WHEN elev * 200 >= 32768 THEN 10000 ELSE elev * 200 END AS INT) AS elev FROM b_cells", "b_cells")
def clean_elevation(spark, sf_dir):
    return load(spark, sf_dir, "b_cells").select(*CELL, fc.elevation(F.col("elev") * 200).alias("elev"))


@query(" SELECT basin_id, r, c, 10 + 0.25 * (c + 0.5) AS x, 60 - 0.25 * (r + 0.5) AS y FROM b_cells", "b_cells")
def cell_midpoints(spark, sf_dir):
    return load(spark, sf_dir, "b_cells").select(*CELL, fc.midpoint(F.col("r"), F.col("c"), 10.0, 60.0, 0.25).alias("p")).select(*CELL, F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query(""", near AS (SELECT p.grp, point_id, vertex_id, p.x, p.y, v.x AS vx, v.y AS vy, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY (p.x - v.x) * (p.x - v.x) + (p.y - v.y) * (p.y - v.y), vertex_id) AS k FROM b_points p JOIN b_ref_vertices v ON p.grp = v.grp)
SELECT grp, point_id, vertex_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(vx AS DOUBLE) AS vx, CAST(vy AS DOUBLE) AS vy FROM near WHERE k = 1""", "b_points", "b_ref_vertices")  # fmt: skip
def snap_connectors(spark, sf_dir):
    found = lines.connectors(load(spark, sf_dir, "b_points"), load(spark, sf_dir, "b_ref_vertices"))
    end = lambda i, k: F.col("line")[i][k]
    return found.select("grp", "point_id", "vertex_id", end(0, "x").alias("x"), end(0, "y").alias("y"), end(1, "x").alias("vx"), end(1, "y").alias("vy"))


def confluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on a coarse grid, so that they share vertices; every third is reference water of order 2."""
    v = load(spark, sf_dir, "b_line_vertices").select("line_id", "pos", F.floor(F.col("x") / 2.0).alias("x"), F.floor(F.col("y") / 2.0).alias("y"))
    return v.withColumns({"from_ref": F.col("line_id") % 3 == 0, "own_order": F.lit(2)})


@query(""", v AS (SELECT line_id, pos, CAST(floor(x / 2.0) AS BIGINT) AS x, CAST(floor(y / 2.0) AS BIGINT) AS y, line_id % 3 = 0 AS from_ref FROM b_line_vertices),
near AS (SELECT *, LEAD(x) OVER w AS tx, LEAD(y) OVER w AS ty, LAG(x) OVER w AS sx, LAG(y) OVER w AS sy FROM v WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
last AS (SELECT x, y, tx, ty FROM near WHERE tx IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY x, y ORDER BY from_ref, line_id DESC, pos DESC) = 1)
SELECT n.x, n.y, bool_or(from_ref) AS from_ref, CASE WHEN bool_or(from_ref) THEN 2 ELSE 1 END AS own_order, COUNT(DISTINCT sx * 1000000 + sy) AS n_sources, MAX(l.tx) AS tx, MAX(l.ty) AS ty
FROM near n LEFT JOIN last l ON l.x = n.x AND l.y = n.y GROUP BY n.x, n.y""", "b_line_vertices")  # fmt: skip
def shared_nodes(spark, sf_dir):
    return network.shared_nodes(confluent(spark, sf_dir))


@query(", v AS (SELECT line_id, pos, CAST(x * 3 + y AS BIGINT) % 50 AS elev FROM b_line_vertices), a AS (SELECT line_id, pos, elev, LEAD(pos) OVER w AS q, LEAD(elev) OVER w AS e FROM v WINDOW w AS (PARTITION BY line_id ORDER BY pos)) SELECT line_id, pos, q AS to_pos, greatest(0, elev - e) AS cost FROM a WHERE q IS NOT NULL UNION ALL SELECT line_id, q, pos, greatest(0, e - elev) FROM a WHERE q IS NOT NULL", "b_line_vertices")
def vertex_graph(spark, sf_dir):
    return network.vertex_graph(load(spark, sf_dir, "b_line_vertices").withColumn("elev", (F.col("x") * 3 + F.col("y")) % 50))


POINT = "CASE WHEN u = 0 THEN o_{k}1 WHEN u = 1 THEN o_{k}2 WHEN t = 0 THEN {k}1 WHEN t = 1 THEN {k}2 ELSE round({k}1 + t * ({k}2 - {k}1), 9) END AS {k}"
NODED = f""", steps AS MATERIALIZED (SELECT line_id, pos, CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, CAST(LEAD(x) OVER w AS DOUBLE) AS x2, CAST(LEAD(y) OVER w AS DOUBLE) AS y2 FROM b_walks WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
live AS MATERIALIZED (SELECT * FROM steps WHERE x2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)),
pairs AS MATERIALIZED (SELECT a.*, b.line_id AS o_line, b.pos AS o_pos, b.x1 AS o_x1, b.y1 AS o_y1, b.x2 AS o_x2, b.y2 AS o_y2,
  (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS d, (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) AS n, (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) AS m
  FROM live a JOIN live b ON (a.line_id < b.line_id OR (a.line_id = b.line_id AND a.pos < b.pos)) AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2)),
spots AS (SELECT *, {POINT.format(k="x")}, {POINT.format(k="y")} FROM (SELECT *, n / NULLIF(d, 0) AS t, m / NULLIF(d, 0) AS u FROM pairs) WHERE d <> 0 AND t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
lying AS (SELECT * FROM pairs WHERE d = 0 AND m = 0),
found AS (SELECT line_id, pos, t, x, y FROM spots UNION ALL SELECT o_line, o_pos, u, x, y FROM spots
{"".join(f" UNION ALL SELECT line_id, pos, ((o_x{k} - x1) * (x2 - x1) + (o_y{k} - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), o_x{k}, o_y{k} FROM lying UNION ALL SELECT o_line, o_pos, ((x{k} - o_x1) * (o_x2 - o_x1) + (y{k} - o_y1) * (o_y2 - o_y1)) / ((o_x2 - o_x1) * (o_x2 - o_x1) + (o_y2 - o_y1) * (o_y2 - o_y1)), x{k}, y{k} FROM lying" for k in (1, 2))}),
met AS MATERIALIZED (SELECT line_id, pos, MIN(t) AS t, x, y FROM found WHERE t > 0 AND t < 1 GROUP BY line_id, pos, x, y),
points AS MATERIALIZED (SELECT line_id, pos, 0.0::DOUBLE AS t, x1 AS x, y1 AS y FROM steps WHERE x2 IS NULL OR x1 <> x2 OR y1 <> y2 UNION ALL SELECT line_id, pos, t, x, y FROM met),
nodes AS (SELECT x, y FROM points GROUP BY x, y HAVING COUNT(*) > 1),
marked AS (SELECT p.*, n.x IS NOT NULL AS node, ROW_NUMBER() OVER w AS step, LEAD(p.pos) OVER w IS NULL AS last FROM points p LEFT JOIN nodes n ON n.x = p.x AND n.y = p.y WINDOW w AS (PARTITION BY line_id ORDER BY p.pos, p.t, p.x, p.y)),
numbered AS (SELECT *, node AND step > 1 AND NOT last AS inside FROM marked),
parted AS (SELECT *, CAST(COALESCE(SUM(CAST(inside AS INT)) OVER (PARTITION BY line_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS part FROM numbered),
both_parts AS (SELECT line_id, part, step, x, y FROM parted UNION ALL SELECT line_id, part + 1, step, x, y FROM parted WHERE inside)"""


@query(NODED + " SELECT line_id, pos, t, x, y FROM met", "b_walks")
def line_crossings(spark, sf_dir):
    return noding.meeting_points(noding.line_steps(load(spark, sf_dir, "b_walks")), 4.0)


@query(NODED + " SELECT line_id, part, COUNT(*) AS n_points, arg_min(x, step) AS x1, arg_min(y, step) AS y1, arg_max(x, step) AS x2, arg_max(y, step) AS y2 FROM both_parts GROUP BY line_id, part", "b_walks")
def noded_lines(spark, sf_dir):
    points = noding.noded(load(spark, sf_dir, "b_walks"), 4.0)
    end = lambda f, k: f(k, "seq")
    return points.groupBy("line_id", "part").agg(F.count("*").alias("n_points"), end(F.min_by, "x").alias("x1"), end(F.min_by, "y").alias("y1"), end(F.max_by, "x").alias("x2"), end(F.max_by, "y").alias("y2"))


@query(""", places AS (SELECT box_id, CAST(r AS INT) AS r, CAST(unnest(range(c0, c1 + 1)) AS INT) AS c FROM (SELECT box_id, unnest(range(r0, r1 + 1)) AS r, c0, c1 FROM b_boxes)),
inside AS MATERIALIZED (SELECT box_id, basin_id, r, c, prob_pct FROM b_cells JOIN b_boxes ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1),
wide AS (SELECT box_id, basin_id FROM inside GROUP BY box_id, basin_id HAVING MIN(r) < MAX(r) AND MIN(c) < MAX(c)),
first AS (SELECT box_id, r, c, arg_min(prob_pct, basin_id) AS prob_pct FROM inside JOIN wide USING (box_id, basin_id) WHERE prob_pct < 90 GROUP BY box_id, r, c)
SELECT box_id, r, c, COALESCE(prob_pct, 0) AS prob_pct FROM places LEFT JOIN first USING (box_id, r, c)""", "b_cells", "b_boxes")  # fmt: skip
def basin_rasters(spark, sf_dir):
    return tables.box_rasters(load(spark, sf_dir, "b_cells"), load(spark, sf_dir, "b_boxes"), "basin_id", "prob_pct", size=8, nodata=90)


#: Corners of a polygon about its own origin: a part with a hole, and a second part.
PARTS = (((0, 0), (12, 3), (15, 14), (4, 11), (0, 0)), ((5, 4), (9, 5), (7, 9), (5, 4)), ((20, 2), (26, 2), (23, 9), (20, 2)))
PLACED = ", placed AS (SELECT c_custkey AS polygon_id, CAST(c_custkey * 17 % 199 AS DOUBLE) AS ox, CAST(c_custkey * 29 % 173 AS DOUBLE) AS oy FROM customer), edges AS (SELECT polygon_id, ox, oy, ox + ax AS ax, oy + ay AS ay, ox + zx AS zx, oy + zy AS zy FROM placed CROSS JOIN (VALUES " + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for ring in PARTS for a, b in zip(ring, ring[1:])) + ") t(ax, ay, zx, zy))"


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("polygon_id"), (F.col("c_custkey") * 17 % 199).cast("double").alias("ox"), (F.col("c_custkey") * 29 % 173).cast("double").alias("oy"))
    ring = lambda corners: F.array(*(F.struct((F.col("ox") + x).alias("x"), (F.col("oy") + y).alias("y")) for x, y in corners))
    return c.select("polygon_id", F.array(*map(ring, PARTS)).alias("rings"))


@query(PLACED + """, boxed AS (SELECT DISTINCT polygon_id, ox, oy FROM edges), cells AS (SELECT polygon_id, gx, unnest(range(CAST(oy AS BIGINT) - 1, CAST(oy AS BIGINT) + 16)) AS gy FROM (SELECT *, unnest(range(CAST(ox AS BIGINT) - 1, CAST(ox AS BIGINT) + 28)) AS gx FROM boxed))
SELECT polygon_id, gx, gy FROM cells JOIN edges USING (polygon_id) GROUP BY polygon_id, gx, gy
HAVING COUNT(*) FILTER (WHERE (ay > gy + 0.5) <> (zy > gy + 0.5) AND gx + 0.5 < (zx - ax) * (gy + 0.5 - ay) / NULLIF(zy - ay, 0) + ax) % 2 = 1""", "b_boxes")  # fmt: skip
def filled_polygons(spark, sf_dir):
    return spatial.filled_cells(polygons(spark, sf_dir), 1.0)


@query(PLACED + """ SELECT point_id, polygon_id FROM b_points p JOIN edges e ON e.polygon_id % 25 = p.grp GROUP BY point_id, polygon_id, p.x, p.y
HAVING COUNT(*) FILTER (WHERE (ay > y) <> (zy > y) AND x < (zx - ax) * (y - ay) / NULLIF(zy - ay, 0) + ax) % 2 = 1""", "b_points")  # fmt: skip
def points_in_holed_polygons(spark, sf_dir):
    held = polygons(spark, sf_dir).withColumn("grp", F.col("polygon_id") % 25)
    return spatial.points_in_polygons(load(spark, sf_dir, "b_points"), held, 16.0, ["grp"]).select("point_id", "polygon_id")


CROSSED = "sign(({q}x - {p}x) * ({c}y - {p}y) - ({q}y - {p}y) * ({c}x - {p}x)) * sign(({q}x - {p}x) * ({d}y - {p}y) - ({q}y - {p}y) * ({d}x - {p}x)) < 0"


@query(PLACED + SIDES + """, sided AS (SELECT x1 AS cx, y1 AS cy, x2 AS dx, y2 AS dy FROM sides),
corner AS (SELECT polygon_id FROM edges CROSS JOIN sided GROUP BY polygon_id, ax, ay HAVING COUNT(*) FILTER (WHERE (cy > ay) <> (dy > ay) AND ax < (dx - cx) * (ay - cy) / NULLIF(dy - cy, 0) + cx) % 2 = 1),
holds AS (SELECT polygon_id FROM edges CROSS JOIN sided GROUP BY polygon_id, cx, cy HAVING COUNT(*) FILTER (WHERE (ay > cy) <> (zy > cy) AND cx < (zx - ax) * (cy - ay) / NULLIF(zy - ay, 0) + ax) % 2 = 1),
crossed AS (SELECT polygon_id FROM edges CROSS JOIN sided WHERE """ + CROSSED.format(p="a", q="z", c="c", d="d") + " AND " + CROSSED.format(p="c", q="d", c="a", d="z") + """)
SELECT polygon_id FROM corner UNION SELECT polygon_id FROM holds UNION SELECT polygon_id FROM crossed""", "b_points")  # fmt: skip
def masked_polygons(spark, sf_dir):
    return spatial.meeting_polygons(polygons(spark, sf_dir), ring_column()).select("polygon_id")


def walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """New lines of eight basins over one another, some vertices of which touch reference water, and reference vertices."""
    v = load(spark, sf_dir, "b_walks").select((F.col("line_id") % 8).alias("basin_id"), "line_id", "pos", "x", "y", ((F.col("x") * 3 + F.col("y")) % 50).alias("elev"), F.expr("pmod(x * 5 + y, 23) = 0 AND line_id % 8 <> 7").alias("touches"))
    ref = load(spark, sf_dir, "b_ref_vertices").select((F.col("vertex_id") % 8).alias("basin_id"), "vertex_id", "x", "y", ((F.col("x") * 3 + F.col("y")) % 50).alias("elev"))
    return v, ref


SNAPPED = """, v AS MATERIALIZED (SELECT line_id % 8 AS basin_id, line_id, pos, x, y, (x * 3 + y) % 50 AS elev, ((x * 5 + y) % 23 + 23) % 23 = 0 AND line_id % 8 <> 7 AS touches, MAX(pos) OVER (PARTITION BY line_id) AS last FROM b_walks),
rule AS (SELECT line_id, bool_or(touches AND pos = 0) AS head, bool_or(touches AND pos = last) AS tail, MIN(CASE WHEN touches THEN pos END) AS first, MAX(last) AS last FROM v GROUP BY line_id),
kept AS MATERIALIZED (SELECT v.*, touches AND pos = CASE WHEN head THEN 0 WHEN tail THEN r.last ELSE first END AS snaps FROM v JOIN rule r USING (line_id) WHERE NOT (head AND tail)),
refs AS (SELECT vertex_id % 8 AS basin_id, vertex_id, x, y, (x * 3 + y) % 50 AS elev FROM b_ref_vertices),
starts AS MATERIALIZED (SELECT s.basin_id, s.x, s.y, r.x AS to_x, r.y AS to_y, CAST(greatest(0, r.elev - s.elev) AS DOUBLE) AS cost FROM (SELECT DISTINCT basin_id, x, y, elev FROM kept WHERE snaps) s JOIN refs r ON r.basin_id = s.basin_id
  QUALIFY ROW_NUMBER() OVER (PARTITION BY s.basin_id, s.x, s.y ORDER BY (s.x - r.x) * (s.x - r.x) + (s.y - r.y) * (s.y - r.y), r.vertex_id) = 1),
ahead AS (SELECT basin_id, x, y, elev, LEAD(x) OVER w AS tx, LEAD(y) OVER w AS ty, LEAD(elev) OVER w AS te FROM kept WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
steps AS MATERIALIZED (SELECT basin_id, x, y, tx, ty, CAST(greatest(0, elev - te) AS DOUBLE) AS cost FROM ahead WHERE tx IS NOT NULL UNION SELECT basin_id, tx, ty, x, y, CAST(greatest(0, te - elev) AS DOUBLE) FROM ahead WHERE tx IS NOT NULL),
dist(basin_id, x, y, d) USING KEY (basin_id, x, y) AS (
SELECT basin_id, x, y, cost AS d FROM starts
UNION
SELECT e.basin_id, e.tx, e.ty, MIN(a.d + e.cost) AS d FROM dist a JOIN steps e ON e.basin_id = a.basin_id AND e.x = a.x AND e.y = a.y
LEFT JOIN recurring.dist o ON o.basin_id = e.basin_id AND o.x = e.tx AND o.y = e.ty WHERE o.d IS NULL OR a.d + e.cost < o.d GROUP BY e.basin_id, e.tx, e.ty)"""


@query(SNAPPED + """ SELECT basin_id, x, y, d AS dist FROM dist UNION ALL SELECT DISTINCT basin_id, x, y, NULL FROM kept WHERE basin_id NOT IN (SELECT basin_id FROM starts)""", "b_walks", "b_ref_vertices", recursive=True)
def snapped_forest(spark, sf_dir):
    return snapping.forest(*walked(spark, sf_dir)).select("basin_id", "x", "y", "dist")


@query(SNAPPED + " SELECT basin_id, x, y, to_x, to_y, cost FROM starts", "b_walks", "b_ref_vertices", recursive=True)
def snapped_places(spark, sf_dir):
    vertices, reference = walked(spark, sf_dir)
    return snapping.snapped(snapping.kept_lines(vertices), reference)
