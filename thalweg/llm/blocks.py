"""Blocks of rows that chunks of queries pass by: each block is read once, whatever the number of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions


def packed(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """work(rows of a group) for every group of equal keys (integers), in the given order; keys must bound their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            first = starts(held)
            for lo, hi in zip(first[:-1], first[1:], strict=True):
                yield work(held.slice(lo, hi - lo).combine_chunks())
            held = held.slice(first[-1]) if len(first) else None
        if held is not None and held.num_rows:
            yield work(held.combine_chunks())

    def starts(table: pa.Table) -> list[int]:
        if not table.num_rows:
            return []
        columns = [table[k].to_numpy() for k in keys]
        return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])).tolist()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def vectors_of(table: pa.Table, column: str, dims: int) -> np.ndarray:
    """The lists of a column, dims values each, as a matrix."""
    flat = table[column].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().reshape(table.num_rows, dims) if dims else np.zeros((table.num_rows, 0), np.int64)


def lanes_for(spark: SparkSession, blocks: int, chunks: int) -> int:
    """How many tasks may share a block so that all partitions have work: no more than there are chunks, one where blocks are many."""
    return max(1, min(chunks, -(-partitions(spark) // max(1, blocks))))


def passed_by(index: DataFrame, asked: DataFrame, key: str, decode: Callable[[dict], object], work: Callable[[object, dict], pa.RecordBatch], schema: str, lanes: int = 1) -> DataFrame:
    """work(decode(block), chunk) for every block of index (one row a key) and every chunk of asked of the same key.

    A block comes before its chunks in one sorted partition, so it is decoded once and no copy of it travels with the
    chunks. Each block is dealt to so many lanes, which share the chunks.
    """
    blocks = index.withColumns({"turn": F.lit(0), "lane": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))})
    chunks = asked.withColumns({"turn": F.lit(1), "lane": F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = at = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["turn"] == 0:
                    held, at = decode(row), row[key]
                elif at == row[key]:
                    yield work(held, row)

    both = blocks.unionByName(chunks, allowMissingColumns=True)
    return both.repartition(key, "lane").sortWithinPartitions(key, "lane", "turn").mapInArrow(run, schema)
