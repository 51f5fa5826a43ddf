"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition deals its (digest, identifier) pairs to some leaves of a tree and sorts each share into a run
with one entry for each digest. The runs are then merged in rounds. The leaves are 0 .. fan_in**rounds - 1; in round t, the fan_in leaves
that differ in digit t only exchange their runs: each takes the slice of the digests whose own digit t is its digit,
and merges the fan_in slices it receives. After the last round every leaf holds the whole of its slice of the digest
space, so no round sends a run to a single place, and every entry moves once a round. Entries of equal digests merge
only if their byte lengths and second digests agree as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, keep_rows, materialize, partitions, text_of

RUN = "node int, digest binary, check long, n_bytes long, keep_id long, keep_row long, group_size long"


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbours of one node, digest, check and length. The rows come sorted by them, then from the row to keep down."""
    last = None  # the entry that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches(([last] if last is not None else []) + [batch]).combine_chunks()
        n = table.num_rows
        digest = np.frombuffer(b"".join(table["digest"].to_pylist()), dtype=np.uint64).reshape(n, 4)
        same = (digest[1:] == digest[:-1]).all(axis=1)
        for name in ("node", "check", "n_bytes"):
            x = table[name].to_numpy()
            same &= x[1:] == x[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.add.reduceat(table["group_size"].to_numpy(), first)
        out = table.take(pa.array(first)).set_column(table.schema.get_field_index("group_size"), "group_size", pa.array(size, pa.int64()))
        out = out.cast(batch.schema).combine_chunks().to_batches()[0]
        last = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if last is not None:
        yield last


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if all their bytes are; a null text equals an empty one. Of equal texts the row with the largest
    identifier stays, a null identifier being the smallest. Of repeated rows with one identifier exactly one has
    kept = true. An empty table gives an empty result; other columns are ignored, whatever their names are.
    """
    spark, text = docs.sparkSession, text_of(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("check"),
            F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    )
    rounds = 1
    while fan_in**rounds < partitions(spark):
        rounds += 1
    leaves = fan_in**rounds
    order = ["node", "digest", "check", "n_bytes", F.col("keep_id").desc_nulls_last(), "keep_row"]
    runs = rows.select(
        F.pmod(F.spark_partition_id() + F.pmod(F.xxhash64("row_no"), F.lit(64)), F.lit(leaves)).cast("int").alias("node"), "digest", "check", "n_bytes", F.col("doc_id").alias("keep_id"),
        F.col("row_no").alias("keep_row"), F.lit(1).cast("long").alias("group_size"),
    )
    runs = runs.sortWithinPartitions(*order).mapInArrow(merge_sorted, RUN)
    for t in range(rounds):
        at = fan_in**t
        mine = F.floor(F.col("node") / at) % fan_in
        theirs = F.pmod(F.floor(F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(leaves)) / at), F.lit(fan_in))
        runs = runs.withColumn("node", (F.col("node") + (theirs - mine) * at).cast("int"))
        runs = runs.repartition(min(leaves, partitions(spark)), "node").sortWithinPartitions(*order).mapInArrow(merge_sorted, RUN)
    groups = materialize(runs.drop("node"), "groups")
    return join_hot(rows, groups, ["digest", "check", "n_bytes"], "group_size").select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """docs, all columns, without the rows that exact_dedup does not keep."""
    of = lambda digest, name: [F.xxhash64(name, digest), F.xxhash64(digest, F.lit(1), name)]
    kept = exact_dedup(docs, id_col, text_col, fan_in).filter("kept").select(*of(F.col("text_sha256"), F.col("doc_id")))
    return keep_rows(docs, of(F.sha2(text_of(text_col), 256), F.col(id_col).cast("long")), kept)
