"""From basins' own segments to one network: global identifiers, links across basins, repaired stream orders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..sources.tables import cut
from .network import strahler_of

MOST_DOUBLINGS = 40
BLOCK_DEPTH = 10
LOT_ROWS = 20_000


def largest_basin(candidates: DataFrame) -> DataFrame:
    """One basin for each stream: the largest, ties to the smaller part_id and part_no."""
    best = F.min_by(F.struct("part_id", "part_no", "area"), F.struct(-F.col("area"), "part_id", "part_no"))
    return candidates.groupBy("stream_id").agg(best.alias("b")).select("stream_id", "b.*")


def global_ids(segments: DataFrame) -> DataFrame:
    """seg_id: 0, 1, .. in the order of basin and local id. Partitions by range are counted, so no task sees all rows."""
    ranged = segments.repartitionByRange("basin_id", "local_id").withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    base = ranged.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("_part").orderBy("basin_id", "local_id")
    return ranged.join(F.broadcast(base), "_part").withColumn("seg_id", F.col("_base") + F.row_number().over(own) - 1).drop("_part", "_base")


def is_exit():
    """A reference segment that leaves its basin."""
    return F.col("from_ref") & (F.col("local_target") == -1) & (F.col("basin_target") != -1)


def is_entry():
    """A reference segment that takes the water of upstream basins."""
    return F.col("from_ref") & (F.size("local_sources") == 0) & (F.col("us1") != -1)


def basin_ends(segments: DataFrame) -> DataFrame:
    """basin_id, entry_id, exit_id: of several the last counts; null where there is none."""
    return segments.groupBy("basin_id").agg(F.max(F.when(is_entry(), F.col("seg_id"))).alias("entry_id"), F.max(F.when(is_exit(), F.col("seg_id"))).alias("exit_id"))


def with_sources(segments: DataFrame) -> DataFrame:
    """local_sources from local_target."""
    into = segments.filter("local_target >= 0").groupBy("basin_id", F.col("local_target").alias("local_id")).agg(F.sort_array(F.collect_list("local_id")).alias("local_sources"))
    return segments.join(into, ["basin_id", "local_id"], "left").withColumn("local_sources", F.coalesce("local_sources", F.array().cast("array<int>")))


def global_targets(segments: DataFrame) -> DataFrame:
    """seg_id, target_seg (-1: none)."""
    ends = basin_ends(segments).select(F.col("basin_id").alias("basin_target"), "entry_id")
    local = segments.select("basin_id", F.col("local_id").alias("local_target"), F.col("seg_id").alias("local_seg"))
    out = segments.join(ends, "basin_target", "left").join(local, ["basin_id", "local_target"], "left")
    return out.select("seg_id", F.coalesce(F.when(is_exit(), F.col("entry_id")).otherwise(F.col("local_seg")), F.lit(-1)).alias("target_seg"))


def global_sources(segments: DataFrame) -> DataFrame:
    """seg_id, source_segs (array in the order of the sources; -1 for a source that is not there).

    Joins are shuffled: a small file of segments may still be many rows for a task to hold.
    """
    ends = basin_ends(segments).select(F.col("basin_id").alias("source_basin"), "exit_id").hint("merge")
    local = segments.select("basin_id", F.col("local_id").alias("source_id"), F.col("seg_id").alias("local_seg")).hint("merge")
    upstream = segments.filter(is_entry()).select("seg_id", F.posexplode(F.array("us1", "us2")).alias("pos", "source_basin")).join(ends, "source_basin", "left").select("seg_id", "pos", F.coalesce("exit_id", F.lit(-1)).alias("source"))
    inside = segments.filter(~is_entry()).select("basin_id", "seg_id", F.posexplode("local_sources").alias("pos", "source_id")).join(local, ["basin_id", "source_id"], "left").select("seg_id", "pos", F.coalesce("local_seg", F.lit(-1)).alias("source"))
    lists = upstream.unionByName(inside).groupBy("seg_id").agg(F.sort_array(F.collect_list(F.struct("pos", "source"))).alias("s"))
    none = F.array().cast("array<bigint>")
    return segments.select("seg_id").join(lists.hint("merge"), "seg_id", "left").select("seg_id", F.coalesce("s.source", none).alias("source_segs"))


def linked_rows(table: pa.Table, before: int) -> pa.RecordBatch:
    """Whole basins, sorted by basin and local id, with row (before, before + 1, ..), target_row (-1: none) and local_sources as rows (-1 for one that is not there).

    Without a column local_sources, a segment's sources are those that have it as their target.
    """
    n = table.num_rows
    basin, local = (pc.fill_null(table[c].cast("int64"), -(1 << 63)).to_numpy() for c in ("basin_id", "local_id"))
    group = np.cumsum(np.concatenate([[False], basin[1:] != basin[:-1]]))
    least, span = int(local.min()), int(local.max()) - int(local.min()) + 1
    keys = group * span + local - least

    def find(groups: np.ndarray, wanted: pa.Array) -> np.ndarray:
        x = pc.fill_null(wanted.cast("int64"), least - 1).to_numpy(zero_copy_only=False) - least
        key = groups * span + x
        at = np.minimum(np.searchsorted(keys, key), n - 1)
        return np.where((x >= 0) & (x < span) & (keys[at] == key), at, -1)

    target = find(group, table["local_target"].combine_chunks())
    if "local_sources" in table.column_names:
        lists = table["local_sources"].combine_chunks()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        sources, none = find(np.repeat(group, counts), lists.flatten()), lists.is_null()
    else:
        at = np.flatnonzero((target >= 0) & pc.fill_null(pc.greater_equal(table["local_target"], 0), False).to_numpy())
        counts, sources, none = np.bincount(target[at], minlength=n), at[np.argsort(target[at], kind="stable")], None
    rows = lambda at: pa.array(np.where(at < 0, -1, at + before))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), rows(sources), mask=none)
    kept = table.drop_columns(["local_sources"]) if "local_sources" in table.column_names else table
    columns = [c.combine_chunks() for c in kept.columns] + [pa.array(np.arange(before, before + n)), rows(target), lists]
    return pa.RecordBatch.from_arrays(columns, [*kept.column_names, "row", "target_row", "local_sources"])


def numbered_links(segments: DataFrame) -> DataFrame:
    """segments with seg_id as of global_ids, inner_target (null: none in the basin), and local_sources as seg_ids, -1 for one that is not there.

    Basins lie whole and sorted in partitions by range, so numbers and the links inside basins come from one shuffle.
    """
    ranged = segments.repartitionByRange("basin_id").sortWithinPartitions("basin_id", "local_id").withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not held.num_rows:
                continue
            basin = pc.fill_null(held["basin_id"], -(1 << 63)).to_numpy()
            if last := int(np.searchsorted(basin, basin[-1])):  # this basin may go on
                yield linked_rows(held.slice(0, last), before)
                held, before = held.slice(last), before + last
        if held is not None and held.num_rows:
            yield linked_rows(held, before)

    schema = ranged.drop("local_sources").schema.add("row", LongType()).add("target_row", LongType()).add("local_sources", ArrayType(LongType()))
    linked = cut(ranged.mapInArrow(run, schema), "linked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    base = linked.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    there = lambda x: F.when(x >= 0, x + F.col("_base"))
    out = linked.join(F.broadcast(base), "_part").withColumns({"seg_id": F.col("_base") + F.col("row"), "inner_target": there(F.col("target_row"))})
    return out.withColumn("local_sources", F.transform("local_sources", lambda x: F.coalesce(there(x), F.lit(-1)))).drop("_part", "_base", "row", "target_row")


def composed(steps: DataFrame, again: DataFrame) -> DataFrame:
    """Two pointer tables (stream_id, ptr, dist; ptr null: past the last stream) one after the other."""
    ahead = again.select(F.col("stream_id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"))
    out = steps.join(ahead, "ptr", "left")
    return out.select("stream_id", F.col("ptr2").alias("ptr"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"))


def depths(streams: DataFrame) -> DataFrame:
    """stream_id, parent (the stream that lists it as a source, null without), depth: streams below it.

    Pointers are doubled twice a round, so rounds are half the logarithm of the depth. Streams above or on a cycle have
    no depth and are left out.
    """
    listed = streams.filter("us1 <> -1").select(F.col("stream_id").alias("parent"), F.explode(F.array("us1", "us2")).alias("stream_id"))
    parents = listed.groupBy("stream_id").agg(F.max("parent").alias("parent"))
    parents = cut(streams.select("stream_id").join(parents, "stream_id", "left"), "parents")
    at = parents.select("stream_id", F.col("parent").alias("ptr"), F.col("parent").isNotNull().cast("long").alias("dist"))
    left = -1
    for _ in range(MOST_DOUBLINGS):
        at = composed(at, at)
        at = cut(composed(at, at), "pointers")
        now = at.filter("ptr IS NOT NULL").count()
        if now in (0, left):
            break  # what is left lies on cycles, or above them
        left = now
    return parents.join(at.filter("ptr IS NULL").select("stream_id", F.col("dist").alias("depth")), "stream_id")


def stages(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Bands from the deepest up (band -> rows), neighbours together as long as a task may hold all of them."""
    out: list[list[int]] = []
    for band in sorted(sizes, reverse=True):
        if out and sum(sizes[b] for b in out[-1]) + sizes[band] <= most:
            out[-1].append(band)
        else:
            out.append([band])
    return out


def by_blocks(streams: DataFrame, rule: Callable[[int, list[int], int], int], as_: str, block: int = BLOCK_DEPTH) -> DataFrame:
    """stream_id and the rule's value of each stream: rule(base order, values of known sources, number of all sources).

    The trees of streams are cut into blocks of `block` levels (2**block - 1 streams at most, since a stream has two
    sources). Bands of blocks are solved from the headwaters down, small ones together in one task; each block passes one
    value to the stream below it.
    Streams on cycles, and above them, keep their base order. Of several streams that list one as a source the one of
    largest identifier takes its value.
    """
    deep = cut(depths(streams), "depths")
    # the first stream of a block points to itself, all others to their parents: doubled, every one finds its block
    top = deep.select("stream_id", F.when(F.col("depth") % block == 0, F.col("stream_id")).otherwise(F.col("parent")).alias("ptr"), F.lit(0).alias("dist"))
    for _ in range(-(-(block - 1).bit_length() // 2)):
        top = composed(top, top)
        top = cut(composed(top, top), "blocks")
    base = streams.select("stream_id", "us1", "us2", "base_order")
    deep = deep.withColumn("parent", F.coalesce("parent", F.lit(-1)))
    held = base.join(deep, "stream_id").join(top.select("stream_id", F.col("ptr").alias("block")), "stream_id").withColumn("band", F.floor(F.col("depth") / block))
    held = cut(held, "banded", by="band")
    sizes = {r.band: r["count"] for r in held.groupBy("band").count().collect()}  # a row for every `block` levels

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("depth", ascending=False, kind="stable")
        value: dict[int, int] = {}
        below: dict[int, dict[int, int]] = {}
        for i, parent, order, us1, us2, given in zip(*(own[c].tolist() for c in ("stream_id", "parent", "base_order", "us1", "us2", "given")), strict=True):
            known = {x["stream_id"]: x["value"] for x in ([] if given is None else given)} | below.get(i, {})
            named = 0 if us1 == -1 else 2
            value[i] = rule(order, [known[u] for u in dict.fromkeys((us1, us2)) if u in known] if named else [], named)
            below.setdefault(parent, {})[i] = value[i]
        return pd.DataFrame({"stream_id": own["stream_id"], "parent": own["parent"], "value": [value[i] for i in own["stream_id"].tolist()], "depth": own["depth"]}).astype({"value": "int32"})

    solved, out = None, None
    for bands in stages(sizes, LOT_ROWS):
        own = held.filter(F.col("band").isin(bands))
        n = sum(sizes[b] for b in bands)
        # a stage of several bands is small enough for one task; else a task takes a lot of whole blocks, about LOT_ROWS rows
        own = own.withColumn("lot", F.lit(0) if len(bands) > 1 else F.pmod(F.xxhash64("block"), F.lit(max(1, -(-n // LOT_ROWS)))).cast("int"))
        if solved is None:
            own = own.withColumn("given", F.lit(None).cast("array<struct<stream_id:long,value:int>>"))
        else:
            passed = solved.filter(F.col("depth") == block * (max(bands) + 1)).groupBy(F.col("parent").alias("stream_id")).agg(F.collect_list(F.struct(F.col("stream_id").alias("stream_id"), "value")).alias("given"))  # two at most
            own = own.join(passed, "stream_id", "left")
        solved = cut(own.groupBy("lot").applyInPandas(run, "stream_id long, parent long, value int, depth long"), "band")
        part = solved.select("stream_id", "value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return base.select("stream_id", F.col("base_order").cast("int").alias(as_))
    return base.join(out, "stream_id", "left").select("stream_id", F.coalesce("value", "base_order").cast("int").alias(as_))


def repaired(base: int, known: list[int], named: int) -> int:
    """A source that is missing, in the data or by name, leaves the largest known order; two equal ones make one more."""
    if named and len(known) == named and known[0] == known[1]:
        return max(base, known[0] + 1)
    return max([base, *known])


def repair_orders(streams: DataFrame) -> DataFrame:
    return by_blocks(streams, repaired, "repaired")


def strahler_orders(streams: DataFrame) -> DataFrame:
    return by_blocks(streams, lambda base, known, named: max(1, strahler_of(known)), "strahler")


def basin_orders(segments: DataFrame) -> DataFrame:
    """One row a basin for repair_orders: its largest segment order, with the links of its first segment."""
    return segments.groupBy(F.col("basin_id").alias("stream_id")).agg(F.max("seg_order").cast("int").alias("base_order"), F.min_by(F.struct(F.col("basin_target").alias("target_id"), "us1", "us2"), "local_id").alias("b")).select("stream_id", "base_order", "b.*")


def merge_network(segments: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """stream_id, target_stream_id, source_stream_ids, stream_order, from_ref, basin_id, and the columns to carry, of all segments of all basins.

    Without local_sources, they are taken from local_target (see with_sources).
    """
    numbered = numbered_links(segments)
    orders = repair_orders(basin_orders(numbered)).withColumnRenamed("stream_id", "basin_id")
    order = F.when(F.col("from_ref"), F.greatest("seg_order", F.coalesce("repaired", F.lit(1)))).otherwise(F.col("seg_order"))
    ends = cut(basin_ends(numbered), "ends")
    entry_of = ends.select(F.col("basin_id").alias("basin_target"), "entry_id").hint("merge")
    below = numbered.filter(is_exit()).select("seg_id", "basin_target").join(entry_of, "basin_target").select("seg_id", "entry_id")
    exit_of = ends.select(F.col("basin_id").alias("source_basin"), "exit_id").hint("merge")
    above = numbered.filter(is_entry()).select("seg_id", F.posexplode(F.array("us1", "us2")).alias("pos", "source_basin")).join(exit_of, "source_basin", "left")
    above = above.groupBy("seg_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("exit_id", F.lit(-1)).alias("source")))).alias("above"))  # two
    out = numbered.join(orders.hint("merge"), "basin_id", "left").join(below.hint("merge"), "seg_id", "left").join(above.hint("merge"), "seg_id", "left")
    sources = F.coalesce(F.when(is_entry(), F.col("above.source")).when(~is_entry(), F.col("local_sources")), F.array().cast("array<bigint>"))
    out = out.withColumns({"target_seg": F.coalesce(F.when(is_exit(), F.col("entry_id")).otherwise(F.col("inner_target")), F.lit(-1)), "source_segs": sources})
    return out.select(F.col("seg_id").alias("stream_id"), F.col("target_seg").alias("target_stream_id"), F.col("source_segs").alias("source_stream_ids"), order.cast("int").alias("stream_order"), "from_ref", "basin_id", *carry)


def streams_with_basins(streams: DataFrame, candidates: DataFrame) -> DataFrame:
    """Streams with the largest basin of their identifier; streams without a basin, and basins without a stream, are left out."""
    return streams.join(largest_basin(candidates), "stream_id")


def basin_max_orders(segments: DataFrame, streams: DataFrame) -> DataFrame:
    """stream_id, max_order, target_id: the largest order of each basin's segments beside its stream; either side may be missing."""
    most = segments.groupBy(F.col("basin_id").alias("stream_id")).agg(F.max("seg_order").cast("int").alias("max_order"))
    return most.join(streams.select("stream_id", "target_id"), "stream_id", "full_outer").select("stream_id", "max_order", "target_id")
