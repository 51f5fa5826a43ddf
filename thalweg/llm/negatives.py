"""Hard negatives by pivot tables.

Components are quantised to integers, and vectors get one more coordinate, sqrt(M - |x|^2) for the rows (M: the largest
squared length of all) and 0 for the anchors. Then

    |anchor' - row'|^2 = |anchor|^2 + M - 2 * anchor.row,

so a high score is a short distance. Every row keeps its distances to a few pivots, and by the triangle inequality an
anchor's own distances to them bracket its distance to the row, hence the score: from above by the largest difference
of the two, from below by the least sum. Brackets are taken for runs of RUN rows first, from the least and largest
distances in the run, and for single rows where a run stays in question; only what may belong to the answer is scored.

Rows are dealt into blocks whatever their label, so a frequent label is spread over all of them; inside a block they
are sorted by label, then by nearest pivot. Chunks of anchors pass by all blocks twice, for the positives and for the
negatives (blocks.py), and what the blocks found is merged by anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitsliced import quantise, usable
from .blocks import lanes_for, packed, passed_by, vectors_of
from .common import materialize

BLOCK_ROWS, CHUNK_ANCHORS, RUN = 1 << 13, 64, 32
#: Pivots are spread-out rows of a sample of this many rows. They only save work: results are exact with any pivots.
PIVOTS, SAMPLE = 16, 1024
#: Distances are kept as 32-bit floats and brackets widened by this part of the longest distance there can be.
SLACK = 1e-6


def choose_pivots(sample: list[list[int]], bound: float, n: int = PIVOTS) -> np.ndarray:
    """n points of the sample that lie far from each other, shorter vectors padded by zeros, with the extra coordinate."""
    width = max((len(v) for v in sample), default=0)
    grid = np.array([v + [0] * (width - len(v)) for v in sample], np.float64).reshape(len(sample), width)
    grid = np.concatenate([grid, np.sqrt(np.maximum(bound - (grid * grid).sum(axis=1, keepdims=True), 0))], axis=1)
    chosen: list[int] = []
    nearest = np.full(len(grid), np.inf)
    while len(chosen) < min(n, len(grid)):
        chosen.append(int(np.argmax(nearest)) if chosen else 0)
        nearest = np.minimum(nearest, ((grid - grid[chosen[-1]]) ** 2).sum(axis=1))
    return grid[chosen]


def pivot_distances(grid: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances [pivot, row] of integer vectors with their extra coordinate; of a pivot the components that the vectors have count."""
    dims = grid.shape[1]
    near = np.zeros((len(pivots), dims))
    near[:, : pivots.shape[1] - 1] = pivots[:, : min(dims, pivots.shape[1] - 1)]
    own, other = (grid.astype(np.float64) ** 2).sum(axis=1) + extra**2, (near**2).sum(axis=1) + pivots[:, -1] ** 2
    dots = near @ grid.T.astype(np.float64) + pivots[:, -1:] * extra
    return np.sqrt(np.maximum(own + other[:, None] - 2 * dots, 0))


class Block:
    """Rows of a block, decoded: sorted by label, with their pivot distances and those of their runs."""

    def __init__(self, row: dict):
        self.n, self.dims, self.bound = row["n"], row["dims"], row["bound"]
        self.ids, self.numbers, self.labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "numbers", "labels"))
        self.grid = np.frombuffer(row["vectors"], row["width"]).reshape(self.n, self.dims)
        self.widest = float(np.abs(self.grid.astype(np.float64)).max(initial=0))
        self.table = np.frombuffer(row["distances"], np.float32).reshape(-1, self.n)
        self.slack = SLACK * (4 * self.bound + 1)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        small = self.dims * self.widest * float(np.abs(anchor.astype(np.float64)).max(initial=0)) < 2**52
        kind = np.float64 if small else np.int64  # exact either way; the first is faster
        return (self.grid[rows].astype(kind) @ anchor.astype(kind)).astype(np.int64)

    def bracket(self, least: np.ndarray, largest: np.ndarray, near: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of rows whose distances to the pivots lie between least and largest [pivot, row]."""
        lower = np.maximum(least - near, near - largest).max(axis=0, initial=0)
        upper = (largest + near).min(axis=0, initial=np.inf)
        total = square + self.bound
        return (total - upper * upper) / 2 - self.slack, (total - lower * lower) / 2 + self.slack

    def brackets(self, lo: int, hi: int, near: np.ndarray, square: float, floor: float, cap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows from lo to hi whose scores may lie between floor and cap, and bounds of their scores."""
        near = near[:, None]
        table = self.table[:, lo:hi]
        runs = np.arange(0, hi - lo, RUN)
        low, high = self.bracket(np.minimum.reduceat(table, runs, axis=1), np.maximum.reduceat(table, runs, axis=1), near, square)
        at = np.flatnonzero(np.repeat((high >= floor) & (low <= cap), RUN)[: hi - lo])
        low, high = self.bracket(table[:, at], table[:, at], near, square)
        keep = (high >= floor) & (low <= cap)
        return at[keep] + lo, low[keep], high[keep]


def highest(bounds: np.ndarray, k: int) -> float:
    """The k-th highest of the bounds, no bound if there are fewer."""
    return float(np.partition(bounds, len(bounds) - k)[len(bounds) - k]) if len(bounds) >= k else -np.inf


def first_of(block: Block, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k by score, then identifier, then row number."""
    return np.lexsort((block.numbers[rows], block.ids[rows], -scores))[:k]


def positives_in(block: Block, label: int, number: int, anchor: np.ndarray, near: np.ndarray, square: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, scores of the first k other rows of the anchor's label."""
    lo, hi = np.searchsorted(block.labels, [label, label + 1])
    if lo == hi:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, low, high = block.brackets(lo, hi, near, square, -np.inf, np.inf)
    other = block.numbers[rows] != number
    rows, low, high = rows[other], low[other], high[other]
    rows = rows[high >= highest(low, k)]
    scores = block.scores(rows, anchor)
    best = first_of(block, rows, scores, k)
    return rows[best], scores[best]


def negatives_in(block: Block, label: int, windows: list[tuple[int, int]], anchor: np.ndarray, near: np.ndarray, square: float, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least, most) the rows and scores of the first k rows of other labels in it."""
    lo, hi = np.searchsorted(block.labels, [label, label + 1])
    floor, cap = min(w[0] for w in windows), max(w[1] for w in windows)
    parts = [block.brackets(a, b, near, square, floor, cap) for a, b in ((0, lo), (hi, block.n)) if a < b]
    rows, low, high = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    wanted = np.zeros(len(rows), bool)
    for least, most in windows:
        sure = (low >= least) & (high <= most)
        wanted |= (low <= most) & (high >= max(least, highest(low[sure], k)))
    rows = rows[wanted]
    scores = block.scores(rows, anchor)
    out = []
    for least, most in windows:
        inside = np.flatnonzero((scores >= least) & (scores <= most))
        best = inside[first_of(block, rows[inside], scores[inside], k)]
        out.append((rows[best], scores[best]))
    return out


def width_of(grid: np.ndarray) -> str:
    return next(t for t in ("<i2", "<i4", "<i8") if np.abs(grid).max(initial=0) <= np.iinfo(t).max)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3,
    between: tuple[int, int] = (50, 95), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    A score is the integer inner product of quantised vectors (floor(scale * x)) of equal length. An anchor's positives
    are its first other rows of the same label, and the negatives of each are the first rows of another label whose
    score is between so many per cent of the positive's; first by score, ties by smaller identifier. label, if given,
    stands in for label_col. Rows with a null identifier, label or vector or a null or non-finite component take no part.
    Repeated rows take part each, also as positives of one another; anchors of one identifier have answers of their own,
    and rows equal in score and identifier come in any order. An anchor without positives, or a positive without
    negatives, has no row; an empty table has no result. Other columns are ignored, whatever their names are.
    """
    spark = vectors.sparkSession
    of = (F.col(label_col) if label is None else label).cast("long")
    rows = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull() & of.isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), of.alias("of"), quantise(vector_col, scale).alias("v"), F.size(vector_col).alias("dims"), F.coalesce(is_anchor, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row_no"))
    rows = materialize(rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), "quantised")
    n, bound, asked = rows.agg(F.count("*"), F.max("square"), F.count_if("asked")).first()
    bound = bound or 0.0
    blocks, chunks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked // CHUNK_ANCHORS))
    sample = [r.v for r in rows.orderBy(F.xxhash64("row_no"), "row_no").limit(SAMPLE).select("v").collect()]
    pivots = choose_pivots(sample, bound)

    def columns(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        dims = table["dims"][0].as_py()
        return dims, vectors_of(table, "v", dims), table["square"].to_numpy()

    def index_block(table: pa.Table) -> pa.RecordBatch:
        dims, grid, square = columns(table)
        distances = pivot_distances(grid, np.sqrt(np.maximum(bound - square, 0)), pivots)
        labels, ids, numbers = (table[k].to_numpy() for k in ("of", "vec_id", "row_no"))
        order = np.lexsort((distances.min(axis=0), distances.argmin(axis=0), labels))
        width = width_of(grid)
        held = {"block": table["part"][0].as_py(), "dims": dims, "n": len(ids), "bound": bound, "width": width}
        held |= {"ids": ids[order].tobytes(), "numbers": numbers[order].tobytes(), "labels": labels[order].tobytes()}
        held |= {"vectors": grid[order].astype(width).tobytes(), "distances": distances[:, order].astype(np.float32).tobytes()}
        return pa.RecordBatch.from_pylist([held], schema=BLOCK)

    def anchor_chunk(table: pa.Table) -> pa.RecordBatch:
        dims, grid, square = columns(table)
        ids, labels, numbers = (table[k].to_numpy() for k in ("vec_id", "of", "row_no"))
        width = width_of(grid)
        near = pivot_distances(grid, np.zeros(len(ids)), pivots).T
        held = [{"row_no": int(no), "anchor_id": int(i), "of": int(o), "dims": dims, "chunk": table["part"][0].as_py(), "square": float(s), "vector": v.astype(width).tobytes(), "near": d.tobytes()} for no, i, o, s, v, d in zip(numbers, ids, labels, square, grid, near, strict=True)]
        return pa.RecordBatch.from_pylist(held, schema=ANCHOR)

    part = lambda k: F.pmod(F.xxhash64("row_no"), F.lit(k)).cast("int").alias("part")
    index = packed(rows.select("dims", part(blocks), "vec_id", "row_no", "of", "v", "square"), ["dims", "part"], [], index_block, BLOCK_SQL)
    index = materialize(index.withColumn("block_no", F.concat_ws("-", "dims", "block")), "pivot-index")
    anchors = materialize(packed(rows.filter("asked").select("dims", part(chunks), "vec_id", "row_no", "of", "v", "square"), ["dims", "part"], ["row_no"], anchor_chunk, ANCHOR_SQL), "anchors")
    places, lanes = index.select("dims", "block_no"), lanes_for(spark, blocks, chunks)

    def dealt(table: DataFrame) -> DataFrame:
        """Chunks of anchors, for every block of vectors of their length."""
        return table.groupBy("dims", "chunk").agg(F.collect_list(F.struct(*(c for c in table.columns if c not in ("dims", "chunk")))).alias("anchors")).join(places, "dims").drop("dims", "chunk")

    def anchor_of(block: Block, a: dict) -> tuple[np.ndarray, np.ndarray, float]:
        size = len(a["vector"]) // block.dims if block.dims else 2
        return np.frombuffer(a["vector"], f"<i{size}"), np.frombuffer(a["near"], np.float64), a["square"]

    def find_positives(block: Block, chunk: dict) -> pa.RecordBatch:
        out = []
        for a in chunk["anchors"]:
            at, scores = positives_in(block, a["of"], a["row_no"], *anchor_of(block, a), positives)
            out += [(a["row_no"], int(block.ids[r]), int(block.numbers[r]), int(s)) for r, s in zip(at, scores, strict=True)]
        return batch_of(out, ["row_no", "positive_id", "positive_no", "positive_score"])

    def find_negatives(block: Block, chunk: dict) -> pa.RecordBatch:
        out = []
        for a in chunk["anchors"]:
            found = negatives_in(block, a["of"], [(w["least"], w["most"]) for w in a["windows"]], *anchor_of(block, a), negatives)
            for w, (at, scores) in zip(a["windows"], found, strict=True):
                out += [(a["row_no"], a["anchor_id"], w["positive_no"], w["positive_id"], w["positive_score"], int(block.ids[r]), int(block.numbers[r]), int(s)) for r, s in zip(at, scores, strict=True)]
        return batch_of(out, ["row_no", "anchor_id", "positive_no", "positive_id", "positive_score", "negative_id", "negative_no", "negative_score"])

    found = passed_by(index, dealt(anchors), "block_no", Block, find_positives, "row_no long, positive_id long, positive_no long, positive_score long", lanes)
    best = Window.partitionBy("row_no").orderBy(F.desc("positive_score"), "positive_id", "positive_no")
    found = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= positives)
    low, high = between
    share = lambda k: F.lit(k).cast("long") * F.col("positive_score")
    limits = found.withColumns({"least": rounded_down(-share(low)) * -1, "most": rounded_down(share(high))}).filter("least <= most")
    windows = limits.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("positive_no", "positive_id", "positive_score", "least", "most"))).alias("windows"))
    again = passed_by(index, dealt(materialize(anchors.join(windows, "row_no"), "windows")), "block_no", Block, find_negatives, "row_no long, anchor_id long, positive_no long, positive_id long, positive_score long, negative_id long, negative_no long, negative_score long", lanes)
    best = Window.partitionBy("row_no", "positive_no").orderBy(F.desc("negative_score"), "negative_id", "negative_no")
    ranked = again.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def rounded_down(hundredths: Column) -> Column:
    """Whole ones in so many hundredths (long), without floating-point numbers."""
    return F.call_function("div", hundredths - F.pmod(hundredths, F.lit(100)), F.lit(100))


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


BLOCK = pa.schema([("block", pa.int32()), ("dims", pa.int32()), ("n", pa.int32()), ("bound", pa.float64()), ("width", pa.string()), *((k, pa.binary()) for k in ("ids", "numbers", "labels", "vectors", "distances"))])
BLOCK_SQL = "block int, dims int, n int, bound double, width string, ids binary, numbers binary, labels binary, vectors binary, distances binary"
ANCHOR = pa.schema([*((k, pa.int64()) for k in ("row_no", "anchor_id", "of")), ("dims", pa.int32()), ("chunk", pa.int32()), ("square", pa.float64()), ("vector", pa.binary()), ("near", pa.binary())])
ANCHOR_SQL = "row_no long, anchor_id long, of long, dims int, chunk int, square double, vector binary, near binary"
