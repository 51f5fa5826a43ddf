"""Nodes where lines meet: crossings, touches and shared stretches, and the parts of lines between nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

#: A square of more steps than this is cut into four, this many times at most.
MOST_STEPS, MOST_CUTS = 256, 12
#: Decimals of crossings, so that three lines through one place cross in one node.
DIGITS = 9


def line_steps(vertices: DataFrame, line: str = "line_id") -> DataFrame:
    """line, pos, x1, y1, x2, y2: the steps from each vertex to the next (null at the last vertex of a line)."""
    w = Window.partitionBy(line).orderBy("pos")
    double = lambda c: F.col(c).cast("double")
    return vertices.select(line, "pos", double("x").alias("x1"), double("y").alias("y1"), F.lead(double("x")).over(w).alias("x2"), F.lead(double("y")).over(w).alias("y2"))


def squares_of(steps: DataFrame, size: float) -> DataFrame:
    """steps with gx, gy of every square of a grid that they touch: column by column, the squares between where a step enters and leaves it."""
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    out = steps.withColumn("gx", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    # a wide margin of a ten-thousandth of a square takes in what rounding leaves out
    at = lambda x: F.when(F.col("x2") == F.col("x1"), None).otherwise(F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    enters, leaves = at(F.greatest(low, F.col("gx") * size)), at(F.least(high, (F.col("gx") + 1) * size))
    y_low, y_high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(y_low, F.coalesce(F.least(enters, leaves) - size / 10_000, y_low))
    last = F.least(y_high, F.coalesce(F.greatest(enters, leaves) + size / 10_000, y_high))
    return out.withColumn("gy", F.explode(F.sequence(F.floor(first / size), F.floor(last / size))))


def dealt(steps: DataFrame, size: float) -> DataFrame:
    """steps with the square (level, gx, gy) of every place; crowded squares are cut into four until they hold few steps or cutting stops helping."""
    own = [c for c in steps.columns]
    left, out, level = squares_of(steps, size).withColumn("level", F.lit(0)), None, 0
    while True:
        left = cut(left, "squares")
        crowded = cut(left.groupBy("gx", "gy").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_STEPS), "crowded")
        if level == MOST_CUTS or crowded.isEmpty():
            return left if out is None else out.unionByName(left)
        calm = left.join(crowded.select("gx", "gy"), ["gx", "gy"], "left_anti")
        out = calm if out is None else out.unionByName(calm)
        level += 1
        parts = squares_of(left.join(crowded.select("gx", "gy"), ["gx", "gy"], "left_semi").withColumnsRenamed({"gx": "px", "gy": "py"}).select(*own, "px", "py"), size / 2**level)
        left = parts.filter((F.floor(F.col("gx") / 2) == F.col("px")) & (F.floor(F.col("gy") / 2) == F.col("py"))).select(*own, "gx", "gy").withColumn("level", F.lit(level))


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def courses(steps: DataFrame, line: str = "line_id") -> DataFrame:
    """line, pos, x1, y1, x2, y2: of the steps of some length that run from and to the same places the first one (least line and pos)."""
    moving = steps.filter("x2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)")
    return moving.groupBy("x1", "y1", "x2", "y2").agg(F.min(F.struct(line, "pos")).alias("f")).select(f"f.{line}", "f.pos", "x1", "y1", "x2", "y2")


def meeting_points(steps: DataFrame, size: float, line: str = "line_id") -> DataFrame:
    """line, pos, t, x, y: the places inside a step (0 < t < 1 along it) where another step of any line meets it, each once.

    Steps that run from and to the same places do not meet inside one another and meet the others alike, so one stands
    for all of them, and each gets what that one meets.
    """
    first = cut(courses(steps, line), "courses")
    met = cut(course_points(first, size, line), "meeting-points")
    return of_steps(steps, first, met, line).select(line, "pos", "t", "x", "y")


def of_steps(steps: DataFrame, first: DataFrame, met: DataFrame, line: str) -> DataFrame:
    """steps with the columns that the step that stands for them has in met (line, pos, others); steps without any are left out."""
    ends = ["x1", "y1", "x2", "y2"]
    named = first.withColumnsRenamed({line: "f_line", "pos": "f_pos"})
    own = steps.join(named.hint("merge"), ends).drop(*ends)
    return own.join(met.withColumnsRenamed({line: "f_line", "pos": "f_pos"}).hint("merge"), ["f_line", "f_pos"]).drop("f_line", "f_pos")


def course_points(steps: DataFrame, size: float, line: str = "line_id") -> DataFrame:
    """line, pos, t, x, y: the meeting points of steps (see meeting_points) of which no two run from and to the same places.

    Two steps meet where they cross, where one ends on the other, and, if they lie on one another, at the ends of either
    that lie inside the other. Both steps get the very same coordinates, rounded to DIGITS where they are no vertex. Steps of no length take no part.
    """
    held = dealt(steps.select(line, "pos", "x1", "y1", "x2", "y2"), size)
    # the pairs of a square are many for its bytes, so tasks are dealt by number and not by size
    held = held.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "level", "gx", "gy")
    other = held.select("level", "gx", "gy", F.col(line).alias("o_line"), F.col("pos").alias("o_pos"), *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")))
    c = F.col
    pairs = held.join(other.hint("shuffle_hash"), ["level", "gx", "gy"]).filter(F.struct(line, "pos") < F.struct(c("o_line").alias(line), c("o_pos").alias("pos")))
    dx, dy, ex, ey = c("x2") - c("x1"), c("y2") - c("y1"), c("o_x2") - c("o_x1"), c("o_y2") - c("o_y1")
    fx, fy = c("o_x1") - c("x1"), c("o_y1") - c("y1")
    pairs = pairs.withColumns({"d": cross(dx, dy, ex, ey), "n": cross(fx, fy, ex, ey), "m": cross(fx, fy, dx, dy)})
    t, u = c("n") / F.nullif(c("d"), F.lit(0.0)), c("m") / F.nullif(c("d"), F.lit(0.0))
    # where a step's own end is the meeting point, its exact coordinates are
    x = F.when(u == 0, c("o_x1")).when(u == 1, c("o_x2")).when(t == 0, c("x1")).when(t == 1, c("x2")).otherwise(F.round(c("x1") + t * dx, DIGITS))
    y = F.when(u == 0, c("o_y1")).when(u == 1, c("o_y2")).when(t == 0, c("y1")).when(t == 1, c("y2")).otherwise(F.round(c("y1") + t * dy, DIGITS))
    point = lambda of, pos, t, x, y: F.struct(of.alias(line), pos.alias("pos"), t.alias("t"), x.alias("x"), y.alias("y"))
    met = F.when((c("d") != 0) & t.between(0, 1) & u.between(0, 1), F.array(point(c(line), c("pos"), t, x, y), point(c("o_line"), c("o_pos"), u, x, y)))
    along = lambda x, y: (x - c("x1")) * dx + (y - c("y1")) * dy
    back = lambda x, y: (x - c("o_x1")) * ex + (y - c("o_y1")) * ey
    own2, other2 = dx * dx + dy * dy, ex * ex + ey * ey
    ends = [point(c(line), c("pos"), along(c(f"o_x{k}"), c(f"o_y{k}")) / own2, c(f"o_x{k}"), c(f"o_y{k}")) for k in (1, 2)]
    ends += [point(c("o_line"), c("o_pos"), back(c(f"x{k}"), c(f"y{k}")) / other2, c(f"x{k}"), c(f"y{k}")) for k in (1, 2)]
    lie = F.when((c("d") == 0) & (c("m") == 0), F.array(*ends))
    found = pairs.select(F.explode(F.coalesce(met, lie)).alias("p")).select("p.*").filter("t > 0 AND t < 1")
    return found.groupBy(line, "pos", "x", "y").agg(F.min("t").alias("t")).select(line, "pos", "t", "x", "y")


def noded(vertices: DataFrame, size: float, line: str = "line_id") -> DataFrame:
    """line, part, seq, x, y: the points of lines broken wherever they meet another line or themselves.

    vertices: line, pos, x, y. Nodes are the places that lines pass more than once. A node inside a line ends one part and
    begins the next, so it is a point of both; part and seq count from 0. Vertices on the spot of the one before are dropped.
    """
    steps = cut(line_steps(vertices, line), "steps")
    still = (F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))
    own = steps.filter(~F.coalesce(still, F.lit(False))).select(line, "pos", F.lit(0.0).alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    points = cut(own.unionByName(meeting_points(steps, size, line)), "points")
    nodes = points.groupBy("x", "y").agg(F.count("*").alias("passes")).filter("passes > 1").select("x", "y", F.lit(True).alias("node"))
    w = Window.partitionBy(line).orderBy("pos", "t", "x", "y")
    marked = points.join(nodes, ["x", "y"], "left").withColumns({"at": F.row_number().over(w), "last": F.lead("pos").over(w).isNull()})
    inner = F.coalesce(F.col("node"), F.lit(False)) & (F.col("at") > 1) & ~F.col("last")
    numbered = marked.withColumn("inner", inner).withColumn("part", F.coalesce(F.sum(F.col("inner").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = numbered.withColumn("part", F.explode(F.when(F.col("inner"), F.array("part", F.col("part") + 1)).otherwise(F.array("part"))))
    seq = F.row_number().over(Window.partitionBy(line, "part").orderBy("at")) - 1
    return both.select(line, F.col("part").cast("int").alias("part"), seq.alias("seq"), "x", "y")


def parts_of(points: DataFrame, line: str = "line_id") -> DataFrame:
    """line, part, line array: noded points as arrays of structs x, y."""
    return points.groupBy(line, "part").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).select(line, "part", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))
