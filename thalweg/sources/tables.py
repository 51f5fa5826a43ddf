"""Tables between stages, tile names and mosaics, resumable sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.geometry import line_length, line_meets_ring, polygon_meets_ring


#: A Parquet file without rows is smaller than this.
EMPTY_BYTES = 1 << 20
#: Tiles that a place of a box tries in the first round.
FIRST_TILES = 4


def cut(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df written to the folder that all executors share and read again, so that an iteration's plan stays small.

    by: a column whose values get folders of their own, so that a filter on it reads only these.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="thalweg-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tile_box(file_name: Column, buffer: float = 0.0) -> Column:
    """w, s, e, n from a name that ends in _w_s_e_n and an extension; null if it does not."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    at = lambda i: F.nullif(F.regexp_extract(file_name, rf"_{number}_{number}_{number}_{number}\.[A-Za-z]+$", i), F.lit("")).cast("double")
    return F.struct((at(1) - buffer).alias("w"), (at(2) - buffer).alias("s"), (at(3) + buffer).alias("e"), (at(4) + buffer).alias("n"))


def tile_index(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """file_name, w, s, e, n of the tiles of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("path").alias("file_name"))
    return files.withColumn("box", tile_box(F.col("file_name"))).select("file_name", "box.*").filter("w IS NOT NULL")


def kept_index(spark: SparkSession, folder: str, index: str, pattern: str = "*.tif") -> DataFrame:
    """tile_index of a folder, written to `index` and read from there until the number of the folder's tiles changes."""
    now = tile_index(spark, folder, pattern)
    try:
        held = spark.read.parquet(index)
        if held.count() == now.count():
            return held
    except AnalysisException:  # there is none yet
        pass
    now.write.mode("overwrite").parquet(index)
    return spark.read.parquet(index)


def cropped(tiles: DataFrame, tile: str, value: str, box: tuple[int, int, int, int], nodata: float = 1e30) -> DataFrame:
    """Cells (tile, r, c, value) inside the box (first and last row, first and last column, all inclusive).

    Tiles of which one row or column at most is left are dropped. Values from nodata on become null.
    """
    r0, r1, c0, c1 = box
    inside = tiles.filter(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))
    wide = inside.groupBy(tile).agg((F.min("r") < F.max("r")).alias("tall"), (F.min("c") < F.max("c")).alias("wide")).filter("tall AND wide")
    return inside.join(wide.select(tile), tile, "left_semi").withColumn(value, F.when(F.col(value) < nodata, F.col(value)))


def box_raster(tiles: DataFrame, tile: str, value: str, box: tuple[int, int, int, int], nodata: float = 1e30) -> DataFrame:
    """r, c, value of every place of the box: of tiles that overlap, that of the least tile with data; without any, 0 (integers) or NaN."""
    r0, r1, c0, c1 = box
    places = tiles.sparkSession.range(r0, r1 + 1).select(F.col("id").cast("int").alias("r")).withColumn("c", F.explode(F.sequence(F.lit(c0), F.lit(c1))))
    found = mosaic(cropped(tiles, tile, value, box, nodata), ["r", "c"], value, tile)
    kind = tiles.schema[value].dataType.typeName()
    none = F.lit(float("nan") if kind in ("float", "double") else 0).cast(kind)
    return places.join(found, ["r", "c"], "left").select("r", "c", F.coalesce(value, none).alias(value))


def box_rasters(tiles: DataFrame, boxes: DataFrame, tile: str, value: str, key: str = "box_id", size: int = 64, nodata: float = 1e30) -> DataFrame:
    """key, r, c, value of every place of every box (boxes: key, r0, r1, c0, c1, inclusive), as box_raster makes it for one.

    Boxes of the same places are made once. Each place of a box tries its tiles in order of rank, a few first and four
    times as many in each further round, and is settled by the first that has data there and two rows and two columns in
    the box; only tiles that are tried are looked at. Boxes meet cells in the squares of a grid that they cover: an
    equi-join, and no box is known to the driver.
    """
    box = ["r0", "r1", "c0", "c1"]
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    shapes = cut(boxes.select(*box).distinct().withColumn("shape", F.monotonically_increasing_id()), "shapes")
    dealt = shapes.withColumn("gr", span("r0", "r1")).withColumn("gc", span("c0", "c1"))
    every = shapes.select("shape", F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1").select("shape", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    cells = cut(tiles.select(tile, "r", "c", value).withColumns({"gr": F.floor(F.col("r") / size), "gc": F.floor(F.col("c") / size)}), "raster-cells")
    data = cells.filter(F.col(value) < nodata)
    ranked = data.groupBy("r", "c", tile).agg(F.min(value).alias(value)).withColumn("n", F.row_number().over(Window.partitionBy("r", "c").orderBy(tile)))
    ranked = cut(ranked, "ranked-cells")
    left, found, past, most = every, None, 0, FIRST_TILES
    while True:
        tried = cut(left.join(ranked.filter((F.col("n") > past) & (F.col("n") <= past + most)), ["r", "c"]), "tried")
        if tried.isEmpty():
            break
        pairs = tried.select("shape", tile).distinct().join(dealt, "shape")
        inside = pairs.join(cells.select(tile, "gr", "gc", "r", "c"), [tile, "gr", "gc"]).filter("r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
        # of each tile what is left in a box must be two rows and two columns at least
        wide = inside.groupBy("shape", tile).agg(F.min("r").alias("a"), F.max("r").alias("b"), F.min("c").alias("d"), F.max("c").alias("e")).filter("a < b AND d < e").select("shape", tile)
        settled = cut(tried.join(wide, ["shape", tile], "left_semi").groupBy("shape", "r", "c").agg(F.min_by(value, "n").alias(value)), "settled")
        found = settled if found is None else found.unionByName(settled)
        left = cut(tried.select("shape", "r", "c").distinct().join(settled, ["shape", "r", "c"], "left_anti"), "unsettled")
        past, most = past + most, most * 4
    kind = tiles.schema[value].dataType.typeName()
    none = F.lit(float("nan") if kind in ("float", "double") else 0).cast(kind)
    if found is None:
        found = every.withColumn(value, none).limit(0)
    rasters = every.join(found, ["shape", "r", "c"], "left").select("shape", "r", "c", F.coalesce(value, none).alias(value))
    return boxes.select(key, *box).join(shapes, box).select(key, "shape").join(rasters, "shape").select(key, "r", "c", value)


def curve_key(box: Column, extent: tuple[float, float, float, float], bits: int = 16) -> Column:
    """Place of a box's middle along a Z-shaped curve through the extent (w, s, e, n)."""
    w, s, e, n = extent
    at = lambda lo, hi, a, b: F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor(((lo + hi) / 2 - a) / max(b - a, 1e-9) * (1 << bits)))).cast("long")
    x, y = at(box["w"], box["e"], w, e), at(box["s"], box["n"], s, n)
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), 2 * k)).bitwiseOR(F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1)), 2 * k + 1))
    return out


def write_by_place(rows: DataFrame, path: str, box: Column, files: int | None = None, **options: str) -> None:
    """rows with their bounds (w, s, e, n) as plain columns, sorted along a curve over files and inside them; a rerun replaces them.

    Row groups then cover small areas and carry their least and largest bounds, so a scan of a place skips the others.
    """
    held = rows.withColumn("_box", box)
    extent = held.agg(F.min("_box.w"), F.min("_box.s"), F.max("_box.e"), F.max("_box.n")).first()
    held = held.withColumn("_key", curve_key(F.col("_box"), tuple(0.0 if x is None else x for x in extent)))
    dealt = held.repartitionByRange(*([] if files is None else [files]), "_key", "_box.w", "_box.s").sortWithinPartitions("_key")
    dealt.select(*rows.columns, "_box.*").write.mode("overwrite").options(**options).parquet(path)


def box_filter(box: tuple[float, float, float, float]) -> Column:
    """Rows whose stored bounds meet the box; Parquet readers take it."""
    w, s, e, n = (F.lit(float(x)) for x in box)
    return (F.col("w") <= e) & (F.col("e") >= w) & (F.col("s") <= n) & (F.col("n") >= s)


def ring_box(ring: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = zip(*ring, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def ring_literal(ring: list[tuple[float, float]]) -> Column:
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring))


def scan_place(spark: SparkSession, path: str, columns: list[str], ring: list[tuple[float, float]], line: str | None = "line", rings: str | None = None) -> DataFrame:
    """The named columns of a table of write_by_place: lines with a length, or polygons (column rings), that meet the ring.

    The ring's box is compared with the stored bounds first, in the reader, so only row groups near it are read.
    """
    near = spark.read.parquet(path).filter(box_filter(ring_box(ring)))
    if rings is not None:
        return near.filter(polygon_meets_ring(F.col(rings), ring_literal(ring))).select(*columns)
    return with_length(near, line).filter(line_meets_ring(F.col(line), ring_literal(ring))).select(*columns)


def scan_lines(spark: SparkSession, path: str, columns: list[str], mask: Column | None = None, line: str = "line") -> DataFrame:
    """The named columns of a Parquet table of lines: those with a length, and those that the mask (a column) lets through."""
    rows = spark.read.parquet(path).select(*columns)
    return with_length(rows if mask is None else rows.filter(mask), line)


def with_length(rows: DataFrame, line: str = "line") -> DataFrame:
    return rows.filter(line_length(F.col(line)) > 0)


def scan_regions(spark: SparkSession, path: str, key: str = "HYBAS_ID", mask: list[tuple[float, float]] | None = None) -> DataFrame:
    """region_id, ring (the outer one, array of structs x, y), rings (it and its holes) of the polygons of a GeoJSON feature collection.

    Multi-polygons give a row for each part. With a mask (the corners of a closed ring), those that meet it.
    """
    schema = f"features array<struct<properties: struct<`{key}`: long>, geometry: struct<type: string, coordinates: string>>>"
    each = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.explode("features").alias("f")).select(F.col(f"f.properties.{key}").alias("region_id"), "f.geometry.type", "f.geometry.coordinates")
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = each.select("region_id", F.explode(F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", many)).alias("rings"))
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    out = parts.select("region_id", rings.alias("rings")).select("region_id", F.get("rings", F.lit(0)).alias("ring"), "rings")
    return out if mask is None else out.filter(polygon_meets_ring(F.col("rings"), ring_literal(mask)))


def write_network(network: DataFrame, path: str) -> None:
    """The final table, ordered by identifier within its files; a rerun replaces it."""
    network.repartitionByRange("stream_id").sortWithinPartitions("stream_id").write.mode("overwrite").parquet(path)


def mosaic(cells: DataFrame, at: list[str], value: str, rank: str, nodata: float = 1e30) -> DataFrame:
    """One value for each place: of tiles that overlap, the one of least rank. Values from nodata on count as missing."""
    return cells.filter(F.col(value) < nodata).groupBy(*at).agg(F.min_by(value, rank).alias(value))


def not_done(work: DataFrame, done: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """What of work is not in the manifest of finished keys."""
    return work if overwrite else work.join(done.select(*keys).distinct(), keys, "left_anti")


def fallback_rows(streams: DataFrame, segments: DataFrame, key: str = "basin_id") -> DataFrame:
    """Streams of basins that made no segment; they stand in unchanged."""
    return streams.join(segments.select(key).distinct(), key, "left_anti")


def write_segments(segments: DataFrame, path: str, region: str = "region_id") -> None:
    """One folder a region; a rerun replaces only the regions that it has."""
    segments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(region).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name of the files that are no whole Parquet files: those whose footer cannot be read, or that give fewer rows than it promises.

    A scan of no column counts rows by footers alone, one of all columns those that can be decoded. Of files without
    rows, those that begin and end with the format's mark and are small are empty tables; the rest is broken.
    """
    named = lambda c: F.regexp_replace(c, "^file:/+", "file:/").alias("file_name")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    files = listing.load(path).select(named("path"), "length")
    try:
        held = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return files.select("file_name")  # no file has a readable footer
    promised = held.groupBy(named("_metadata.file_path")).agg(F.count("*").alias("promised"))
    given = held.groupBy(named("_metadata.file_path")).agg(F.count("*").alias("given"), F.bit_xor(F.xxhash64(*held.columns)).alias("all_columns"))
    counted = promised.join(given.filter("all_columns IS NOT NULL"), "file_name", "left").select("file_name", (F.col("promised") == F.coalesce("given", F.lit(0))).alias("whole"))
    odd = cut(files.join(counted.filter("whole"), "file_name", "left_anti").join(counted.select("file_name", F.lit(True).alias("has_rows")), "file_name", "left"), "odd-files")
    small = [r.file_name for r in odd.filter((F.col("length") < EMPTY_BYTES) & F.col("has_rows").isNull()).collect()]  # few
    if not small:
        return odd.select("file_name")
    mark = F.lit("PAR1").cast("binary")
    looked = listing.load(small).filter((F.col("length") >= 12) & (F.substring("content", 1, 4) == mark) & (F.expr("substring(content, CAST(length AS INT) - 3, 4)") == mark))
    return odd.select("file_name").join(looked.select(named("path")), "file_name", "left_anti")


def read_segments(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """All written segments; files that are missing or broken are left out, and the names of broken ones are written to `quarantine`."""
    if quarantine is not None:
        broken_files(spark, path).write.mode("overwrite").parquet(quarantine)
    return spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").parquet(path)
