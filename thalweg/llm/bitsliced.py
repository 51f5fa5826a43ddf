"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers. The rows are dealt into blocks; in a block, slice (d, b) is the bitmap of the
rows whose attribute d, less the block's minimum, has bit b. A query's score is a sum of attributes times constants,
that is of slices shifted by the set bits of each constant, so carry-save adders over whole bitmaps give the slices of
all scores of the block at once (a negative constant takes the complement of its slices). The top rows are then
selected from the most significant slice downward, and the rows that tie at the border are resolved by identifier.

Blocks of queries meet blocks of rows, so no row of one side meets a row of the other in a join. A block is sent and read
once, and the queries pass by it (blocks.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import lanes_for, packed, passed_by, vectors_of
from .common import materialize

BLOCK_ROWS, CHUNK_QUERIES = 1 << 16, 64


def quantise(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def usable(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def slices_of(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each column, and slices [column, bit, word] of the rest as 64-bit words."""
    low = grid.min(axis=0)
    rest = (grid - low).astype(np.uint64)
    bits = max(1, int(rest.max(initial=0)).bit_length())
    padded = np.zeros((-(-len(grid) // 64) * 64, grid.shape[1]), np.uint64)
    padded[: len(grid)] = rest
    planes = np.stack([np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little") for b in range(bits)], axis=1)
    return low, np.ascontiguousarray(planes).view(np.uint64)


def add_slices(slices: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Slices [bit, word] of sum(|query[d]| * y[d]), where y[d] is attribute d's offset, complemented if query[d] < 0."""
    n_bits, words = slices.shape[1], slices.shape[2]
    size = np.abs(query)
    d, j = np.nonzero((size[:, None] >> np.arange(max(1, int(size.max(initial=0)).bit_length()))) & 1)
    d, j, b = np.repeat(d, n_bits), np.repeat(j, n_bits), np.tile(np.arange(n_bits), len(d))
    level = j + b
    flip = np.where(query[d] < 0, ~np.uint64(0), np.uint64(0))
    out, carried, at = [], [], 0
    top = int(level.max(initial=-1))
    while at <= top or carried:
        own = level == at
        stack = slices[d[own], b[own]] ^ flip[own][:, None]
        if carried:
            stack = np.concatenate([stack, *carried])
        carried = []
        while len(stack) > 1:
            if len(stack) == 2:  # half adder
                carried.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
                break
            m = len(stack) // 3
            x, y, z, rest = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m], stack[3 * m :]
            xy = x ^ y
            carried.append((x & y) | (z & xy))
            stack = np.concatenate([xy ^ z, rest]) if len(rest) else xy ^ z
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        at += 1
    return np.array(out, np.uint64).reshape(len(out), words)


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(scores: np.ndarray, among: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k rows of highest score among those of the bitmap, ties to smaller ids; all of them if they are fewer."""
    sure, edge = np.zeros_like(among), among
    taken = 0
    for plane in scores[::-1]:
        high = edge & plane
        n = int(np.bitwise_count(high).sum())
        if taken + n > k:
            edge = high
        else:
            sure, edge, taken = sure | high, edge & ~plane, taken + n
            if taken == k:
                edge = np.zeros_like(edge)
                break
    ties = rows_of(edge)
    ties = ties[np.argsort(ids[ties], kind="stable")[: k - taken]]
    return np.concatenate([rows_of(sure), ties])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long) of the k rows of highest score of each query row.

    A query's candidates are all usable rows of its length but itself; repeated rows are candidates each, also of one
    another, and queries of one identifier have their own answers each. Rows of null identifier take no part. Ties go to
    the smaller identifier. An empty table has no result; other columns are ignored, whatever their names are.

    Queries meet every block, so what is sent is rows * queries / BLOCK_ROWS narrow integers a component, and the work of
    an exact search, rows * queries, is what grows fastest.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull()).withColumn("asked", F.coalesce(is_query, F.lit(False)))
    rows = materialize(rows.select(F.col(id_col).cast("long").alias("vec_id"), quantise(vector_col, scale).alias("v"), F.size(vector_col).alias("dims"), "asked", F.monotonically_increasing_id().alias("row_no")), "quantised")
    n = rows.count()
    blocks, chunks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-rows.filter("asked").count() // CHUNK_QUERIES))

    def dealt(df: DataFrame, parts: int, work, schema: str) -> DataFrame:
        def of(table: pa.Table) -> pa.RecordBatch:
            dims = table["dims"][0].as_py()
            return work(dims, table["part"][0].as_py(), table["vec_id"].to_numpy(), table["row_no"].to_numpy(), vectors_of(table, "v", dims))

        df = df.select("dims", F.pmod(F.xxhash64("row_no"), F.lit(parts)).cast("int").alias("part"), "vec_id", "row_no", "v")
        return packed(df, ["dims", "part"], ["vec_id", "row_no"], of, schema)

    def index_block(dims, part, ids, numbers, grid):
        low, slices = slices_of(grid) if dims else (np.zeros(0, np.int64), np.zeros((0, 1, -(-len(ids) // 64)), np.uint64))
        return pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "block": pa.array([part], pa.int32()), "ids": [ids.tobytes()], "numbers": [numbers.tobytes()], "low": [low.tobytes()], "bits": pa.array([slices.shape[1]], pa.int32()), "slices": [slices.tobytes()]})

    def query_chunk(dims, part, ids, numbers, grid):
        width = next(t for t in ("<i2", "<i4", "<i8") if abs(grid).max(initial=0) <= np.iinfo(t).max)
        grid = grid.astype(width)
        return pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "chunk": pa.array([part], pa.int32()), "query_ids": [ids.tobytes()], "query_numbers": [numbers.tobytes()], "width": [width], "queries": [np.ascontiguousarray(grid).tobytes()]})

    def decode(row: dict) -> dict:
        ids, words = np.frombuffer(row["ids"], np.int64), -(-len(row["ids"]) // 512)
        slices = np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], row["bits"], words)
        there = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
        return row | {"ids": ids, "numbers": np.frombuffer(row["numbers"], np.int64), "low": np.frombuffer(row["low"], np.int64), "slices": slices, "there": there}

    def search(block: dict, row: dict) -> pa.RecordBatch:
        ids, numbers = block["ids"], block["numbers"]
        query_ids, query_numbers = (np.frombuffer(row[k], np.int64) for k in ("query_ids", "query_numbers"))
        queries = np.frombuffer(row["queries"], row["width"]).reshape(len(query_ids), block["dims"]).astype(np.int64)
        found: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        for query_id, number, query in zip(query_ids.tolist(), query_numbers.tolist(), queries, strict=True):
            among = block["there"]
            if len(own := np.flatnonzero(numbers == number)):
                among = among.copy()
                np.bitwise_and.at(among, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
            scores = add_slices(block["slices"], query)
            top = top_rows(scores, among, ids, k)
            bits = (scores[:, top // 64] >> (top % 64).astype(np.uint64)) & np.uint64(1)
            full = (1 << block["bits"]) - 1
            base = int(np.where(query >= 0, query * block["low"], query * (block["low"] + full)).sum())
            found.append((query_id, number, ids[top], numbers[top], base + (bits.astype(np.int64) << np.arange(len(scores))[:, None]).sum(axis=0)))
        counts = [len(x[2]) for x in found]
        each = [np.repeat([x[k] for x in found], counts) for k in (0, 1)] + [np.concatenate([x[k] for x in found]) for k in (2, 3, 4)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in each], ["query_id", "query_number", "vec_id", "row_no", "score"])

    name = F.concat_ws("-", "dims", "block").alias("block_no")
    index = dealt(rows, blocks, index_block, "dims int, block int, ids binary, numbers binary, low binary, bits int, slices binary")
    index = materialize(index.select("dims", name, "ids", "numbers", "low", "bits", "slices"), "slices")
    asked = dealt(rows.filter("asked"), chunks, query_chunk, "dims int, chunk int, query_ids binary, query_numbers binary, width string, queries binary")
    asked = asked.join(index.select("dims", "block_no"), "dims").drop("dims", "chunk")
    found = passed_by(index, asked, "block_no", decode, search, "query_id long, query_number long, vec_id long, row_no long, score long", lanes_for(spark, blocks, chunks))
    best = Window.partitionBy("query_id", "query_number").orderBy(F.desc("score"), "vec_id", "row_no")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
