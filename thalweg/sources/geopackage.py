"""GeoPackage tables as a Spark data source: spark.read.format("geopackage").option("table", ..).load(path).

A GeoPackage is an SQLite file. Its rows are dealt to tasks by ranges of row numbers, only the named columns are read,
and a box is looked up in the file's own spatial index, or compared with the bounds in front of each geometry. Files are
opened where they lie, so the path must be one that all executors have mounted.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Types of the format's columns as Spark's; all others are strings.
TYPES = {"BOOLEAN": "boolean", "TINYINT": "int", "SMALLINT": "int", "MEDIUMINT": "int", "INT": "long", "INTEGER": "long", "FLOAT": "double", "DOUBLE": "double", "REAL": "double", "BLOB": "binary"}
GEOMETRY = "struct<kind:int,parts:array<array<struct<x:double,y:double>>>>"
#: Doubles of the bounds in front of a geometry, by the code in its flags.
BOUNDS = {0: 0, 1: 4, 2: 6, 3: 6, 4: 8}
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = range(1, 8)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path.removeprefix('file://').removeprefix('file:'))}?mode=ro", uri=True)


def read_wkb(data: bytes, at: int = 0) -> tuple[int, list[list[tuple[float, float]]], int]:
    """Kind, parts (of points, lines or rings, one after the other) and end of a WKB geometry; heights and measures are passed over."""
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    kind, extra = code & 0xFF if code > 0xFFFF else code % 1000, 0
    if code > 0xFFFF:  # flags in the high bits
        extra = (code >> 31 & 1) + (code >> 30 & 1)
        at += 4 * (code >> 29 & 1)
    else:
        extra = (0, 1, 1, 2)[code // 1000]

    def points(n: int, at: int) -> tuple[list[tuple[float, float]], int]:
        width = 2 + extra
        flat = struct.unpack_from(f"{order}{n * width}d", data, at)
        return list(zip(flat[::width], flat[1::width], strict=True)), at + 8 * n * width

    def counted(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == POINT:
        own, at = points(1, at)
        return kind, [own] if own[0][0] == own[0][0] else [], at  # an empty point has no coordinates
    n, at = counted(at)
    parts: list[list[tuple[float, float]]] = []
    if kind == LINE:
        own, at = points(n, at)
        return kind, [own] if own else [], at
    for _ in range(n):
        if kind == POLYGON:
            m, at = counted(at)
            own, at = points(m, at)
            parts.append(own)
        else:
            _, own_parts, at = read_wkb(data, at)
            parts += own_parts
    return kind, parts, at


def read_geometry(blob: bytes | None) -> tuple[int, list[list[tuple[float, float]]]] | None:
    if blob is None or blob[:2] != b"GP":
        return None
    return read_wkb(blob, 8 + 8 * BOUNDS[blob[3] >> 1 & 7])[:2]


def box_of(blob: bytes | None) -> tuple[float, float, float, float] | None:
    """w, s, e, n of a geometry: those in front of it, or of its points; None without any."""
    if blob is None or blob[:2] != b"GP":
        return None
    if BOUNDS[blob[3] >> 1 & 7]:
        w, e, s, n = struct.unpack_from(("<" if blob[3] & 1 else ">") + "4d", blob, 8)
        return (w, s, e, n) if w == w else None
    xs, ys = zip(*(p for part in read_geometry(blob)[1] for p in part), strict=True) if read_geometry(blob)[1] else ((), ())
    return (min(xs), min(ys), max(xs), max(ys)) if xs else None


@dataclass
class RowRange(InputPartition):
    first: int
    last: int


class GeoPackage(DataSource):
    """Options: table (by default the first of features), columns (names by commas, by default all), box (w,s,e,n), rows (of a task, 100,000 by default)."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def described(self) -> tuple[str, str | None, dict[str, str]]:
        """The table, its geometry column, and all of its columns with their types."""
        with opened(self.options["path"]) as held:
            table = self.options.get("table") or held.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name").fetchone()[0]
            shape = held.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", [table]).fetchone()
            columns = {name: kind.upper().split("(")[0] for _, name, kind, *_ in held.execute(f"PRAGMA table_info({quoted(table)})")}
        if not columns:
            raise ValueError(f"no table {table} in {self.options['path']}")
        return table, shape[0] if shape else None, {c: GEOMETRY if shape and c == shape[0] else TYPES.get(k, "string") for c, k in columns.items()}

    def wanted(self, known: dict[str, str]) -> list[str]:
        named = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else list(known)
        if missing := [c for c in named if c not in known]:
            raise ValueError(f"no such columns: {missing}")
        return named

    def schema(self) -> str:
        known = self.described()[2]
        return ", ".join(f"`{c}` {known[c]}" for c in self.wanted(known))

    def reader(self, schema) -> DataSourceReader:
        table, shape, known = self.described()
        box = tuple(map(float, self.options["box"].split(","))) if self.options.get("box") else None
        return Reader(self.options["path"], table, shape, {c: known[c] for c in self.wanted(known)}, box, int(self.options.get("rows", 100_000)))


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, shape: str | None, columns: dict[str, str], box: tuple | None, rows: int):
        self.path, self.table, self.shape, self.columns, self.box, self.rows = path, table, shape, columns, box, rows

    def partitions(self) -> list[RowRange]:
        with opened(self.path) as held:
            low, high = held.execute(f"SELECT MIN(rowid), MAX(rowid) FROM {quoted(self.table)}").fetchone()
        return [RowRange(0, -1)] if low is None else [RowRange(a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        with opened(self.path) as held:
            index = f"rtree_{self.table}_{self.shape}"
            known = self.box and held.execute("SELECT 1 FROM sqlite_master WHERE name = ?", [index]).fetchone()
            names = [quoted(c) for c in self.columns] + ([quoted(self.shape)] if self.box and not known else [])
            query, values = f"SELECT {', '.join(names)} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ?", [partition.first, partition.last]
            if known:
                w, s, e, n = self.box
                query += f" AND rowid IN (SELECT id FROM {quoted(index)} WHERE minx <= ? AND maxx >= ? AND miny <= ? AND maxy >= ?)"
                values += [e, w, n, s]
            decode = [read_shape if kind == GEOMETRY else bool_or_none if kind == "boolean" else str_or_none if kind == "string" else None for kind in self.columns.values()]
            for row in held.execute(query, values):
                if self.box and not known and not meets(box_of(row[-1]), self.box):
                    continue
                yield tuple(x if f is None else f(x) for x, f in zip(row, decode, strict=False))


def meets(own: tuple | None, box: tuple) -> bool:
    return own is not None and own[0] <= box[2] and own[2] >= box[0] and own[1] <= box[3] and own[3] >= box[1]


def read_shape(blob: bytes | None):
    found = read_geometry(blob)
    return None if found is None else (found[0], [[(float(x), float(y)) for x, y in part] for part in found[1]])


def bool_or_none(x):
    return None if x is None else bool(x)


def str_or_none(x):
    return None if x is None else str(x)


def scan_geopackage(spark: SparkSession, path: str, table: str | None = None, columns: list[str] | None = None, box: tuple[float, float, float, float] | None = None, rows: int = 100_000) -> DataFrame:
    """A table of a GeoPackage, its geometries as struct kind, parts (lines, or rings); see GeoPackage. Names must not hold commas."""
    spark.dataSource.register(GeoPackage)
    options = {"table": table, "columns": None if columns is None else ",".join(columns), "box": None if box is None else ",".join(map(repr, map(float, box))), "rows": str(rows)}
    return spark.read.format("geopackage").options(**{k: v for k, v in options.items() if v is not None}).load(path)
