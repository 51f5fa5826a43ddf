"""Kernels that take many whole groups at once, so that a group costs its rows and not a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a kernel takes at once; a group that is larger comes alone.
LOT = 1 << 16


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows shuffled by keys into as many tasks as the session shuffles to, however few bytes they are: small rows may be much work.

    By a hash of the keys, for Spark leaves a shuffle by keys out where rows come from one, and puts small partitions of that together.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, F.xxhash64(*keys)) if keys else rows.repartition(tasks)


def changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a group starts at each row; groups come one after the other."""
    out = np.arange(len(rows)) == 0
    for k in keys:
        column = rows.column(k).combine_chunks()
        for x in (column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)):
            out[1:] |= x[1:] != x[:-1]
    return out


def by_lots(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run over tables of whole groups (integer columns keys), in the order of keys and `order`."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, most = [], 0, LOT
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < most:
                continue
            lot = pa.Table.from_batches(held)
            last = int(np.flatnonzero(changes(lot, keys))[-1])  # this group may go on
            if last:
                yield from run(lot.slice(0, last)).to_batches(10_000)
                held = lot.slice(last).to_batches()
                count = len(lot) - last
            most = max(LOT, 2 * count)
        if count:
            yield from run(pa.Table.from_batches(held)).to_batches(10_000)

    return dealt(rows, *keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)
