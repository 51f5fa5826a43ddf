"""Boxes of raster tiles from their headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Tags of a TIFF header, and bytes and codes of its number types.
WIDTH, HEIGHT, PIXEL_SCALE, TIE_POINT = 256, 257, 33550, 33922
NUMBERS = {3: "H", 4: "I", 12: "d", 16: "Q"}
HEADER_TAGS = (WIDTH, HEIGHT, PIXEL_SCALE, TIE_POINT)
BOX = StructType([StructField(k, DoubleType()) for k in "wsen"])


def header_tags(data: bytes) -> dict[int, tuple]:
    """The tags of HEADER_TAGS in the first directory of a TIFF or BigTIFF file; none if it is no such file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 16:
        return {}
    get = lambda code, at: struct.unpack_from(order + code, data, at)
    (version,) = get("H", 2)
    if version not in (42, 43):
        return {}
    big = version == 43
    (at,) = get("Q", 8) if big else get("I", 4)
    (n,) = get("Q" if big else "H", at)
    at += 8 if big else 2
    size, room = (20, 8) if big else (12, 4)
    out = {}
    for k in range(n):
        tag, kind, count = get("HHQ" if big else "HHI", at + k * size)
        if tag in HEADER_TAGS and kind in NUMBERS:
            here = at + k * size + size - room
            if struct.calcsize(order + NUMBERS[kind]) * count > room:
                (here,) = get("Q" if big else "I", here)
            out[tag] = get(f"{count}{NUMBERS[kind]}", here)
    return out


def header_box(data: bytes | None) -> tuple[float, float, float, float] | None:
    """w, s, e, n from a raster's size, pixel scale and tie point; None without them or in a file that ends early."""
    try:
        tags = header_tags(bytes(data or b""))
    except struct.error:
        return None
    if any(t not in tags for t in HEADER_TAGS):
        return None
    (i, j, _, x, y, _), (dx, dy, *_) = tags[TIE_POINT][:6], tags[PIXEL_SCALE]
    w, n = x - i * dx, y + j * dy
    return w, n - tags[HEIGHT][0] * dy, w + tags[WIDTH][0] * dx, n


@F.pandas_udf(BOX)
def box_of_header(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header_box(x) or (None,) * 4 for x in contents], columns=["w", "s", "e", "n"], dtype="float64")


def header_index(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """file_name, w, s, e, n of the tiles of a folder, in the rasters' own coordinates; files without a box are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("path").alias("file_name"), box_of_header("content").alias("b")).select("file_name", "b.*").filter("w IS NOT NULL")
