"""Network-shaped views over the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("supplier", "customer", "part", "orders", "lineitem", "events")
VIEWS = {
    "b_cells": """
SELECT CAST(floor(l_suppkey / 5.0) AS BIGINT) AS basin_id, CAST(l_partkey % 32 AS INT) AS r, CAST((l_orderkey * 7 + l_linenumber) % 32 AS INT) AS c,
       CAST(SUM(CAST(l_quantity AS BIGINT)) * 37 % 101 AS INT) AS prob_pct,
       CAST((l_partkey % 32) * 10 + ((l_orderkey * 7 + l_linenumber) % 32) * 3 + SUM(CAST(l_linenumber AS BIGINT)) % 7 AS INT) AS elev
FROM lineitem GROUP BY CAST(floor(l_suppkey / 5.0) AS BIGINT), l_partkey % 32, (l_orderkey * 7 + l_linenumber) % 32""",
    "b_cells_masked": """
SELECT *, (c = 16 AND r BETWEEN 2 AND 29) AS is_ref, (r BETWEEN 2 AND 29 AND c BETWEEN 2 AND 29 AND r + c > 6) AS in_basin FROM b_cells""",
    "b_streams": """
SELECT o_orderkey AS stream_id, CASE WHEN o_orderkey = 0 THEN -1 ELSE CAST(floor((o_orderkey - 1) / 2.0) AS BIGINT) END AS target_id,
       CASE WHEN 2 * o_orderkey + 1 <= mx THEN 2 * o_orderkey + 1 ELSE -1 END AS us1,
       CASE WHEN 2 * o_orderkey + 2 <= mx THEN 2 * o_orderkey + 2 ELSE -1 END AS us2, CAST(1 + o_custkey % 3 AS INT) AS base_order
FROM orders CROSS JOIN (SELECT MAX(o_orderkey) AS mx FROM orders) m WHERE o_custkey % 97 <> 0""",
    "b_segments": """
SELECT s.stream_id AS basin_id, CAST(k.i AS INT) AS local_id, (k.i < s.base_order) AS from_ref,
       CASE WHEN k.i = s.base_order THEN s.base_order - 1 WHEN k.i = s.base_order - 1 THEN -1 ELSE CAST(k.i AS INT) + 1 END AS local_target,
       CASE WHEN k.i < s.base_order THEN s.base_order ELSE 1 END AS seg_order, s.target_id AS basin_target, s.us1, s.us2
FROM b_streams s CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k
WHERE k.i < s.base_order OR (k.i = s.base_order AND s.base_order > 1)""",
    "b_basin_candidates": "SELECT l_orderkey AS stream_id, l_partkey AS part_id, l_linenumber AS part_no, l_extendedprice AS area FROM lineitem",
    "b_tiles": """
SELECT s_suppkey AS tile_id, CAST(s_suppkey % 10 AS DOUBLE) AS w, CAST(floor(s_suppkey / 10.0) AS DOUBLE) AS s,
       CAST(s_suppkey % 10 + 1 AS DOUBLE) AS e, CAST(floor(s_suppkey / 10.0) + 1 AS DOUBLE) AS n FROM supplier""",
    "b_bboxes": """
SELECT c_custkey AS bbox_id, CAST(c_custkey % 97 AS DOUBLE) / 10 AS w, CAST(c_custkey % 89 AS DOUBLE) / 10 AS s,
       CAST(c_custkey % 97 + 5 AS DOUBLE) / 10 AS e, CAST(c_custkey % 89 + 5 AS DOUBLE) / 10 AS n FROM customer""",
    "b_line_vertices": """
SELECT user_id AS line_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) - 1 AS pos,
       CAST(event_id % 64 AS INT) AS x, CAST(floor(event_id / 64.0) AS BIGINT) % 64 AS y FROM events""",
    "b_walks": """
SELECT user_id AS line_id, CAST(ROW_NUMBER() OVER w AS INT) - 1 AS pos,
       CAST(user_id * 37 % 97 + SUM(CAST(event_id * 7 % 5 AS BIGINT) - 2) OVER w AS BIGINT) AS x, CAST(user_id * 53 % 89 + SUM(CAST(event_id * 3 % 7 AS BIGINT) - 3) OVER w AS BIGINT) AS y
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "b_boxes": """
SELECT c_custkey AS box_id, CAST(c_custkey % 29 AS INT) AS r0, CAST(c_custkey % 29 + 2 + c_custkey % 3 AS INT) AS r1,
       CAST(c_custkey * 7 % 27 AS INT) AS c0, CAST(c_custkey * 7 % 27 + 3 AS INT) AS c1 FROM customer""",
    "b_points": "SELECT p_partkey AS point_id, p_partkey % 25 AS grp, CAST(p_size AS BIGINT) AS x, (p_partkey * 13) % 50 AS y FROM part",
    "b_ref_cells": "SELECT basin_id, basin_id AS line_id, r AS pos, r, c FROM b_cells_masked WHERE is_ref",
    "b_ref_vertices": "SELECT c_custkey AS vertex_id, CAST(c_nationkey AS BIGINT) AS grp, (c_custkey * 17) % 50 AS x, (c_custkey * 29) % 50 AS y FROM customer",
}
NEEDS = {"b_cells_masked": ("b_cells",), "b_ref_cells": ("b_cells", "b_cells_masked"), "b_segments": ("b_streams",)}


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for name in (*NEEDS.get(view, ()), view):
        out = spark.sql(VIEWS[name])
        out.createOrReplaceTempView(name)
    return out


def with_views(sql: str, *views: str, recursive: bool = False) -> str:
    """The SQL behind the views that it reads, as one statement."""
    names = dict.fromkeys(x for v in views for x in (*NEEDS.get(v, ()), v))
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names) + sql
