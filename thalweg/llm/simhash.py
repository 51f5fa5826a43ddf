"""SimHash near-duplicates with pivot distance tables.

Every text gets a 64-bit fingerprint of its word shingles; only distinct fingerprints go on. Two fingerprints that
differ in at most 2 bits agree in at least two of four 16-bit blocks, so each fingerprint is put into six groups, one
for each pair of blocks, and every link lies inside a group. A group that is too large is split by the same argument
over its remaining bits until it is small, so no task has to hold an unbounded group.

Inside the groups, pairs come from pivot tables: the Hamming distances of every fingerprint to many reference
fingerprints are computed beforehand. By the triangle inequality, linked fingerprints differ by at most 2 in every
coordinate, so pairs of larger maximum coordinate difference are discarded, and the survivors are verified. Members
that a representative already links are not compared with one another, for they are connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import in_parts
from .common import join_hot, materialize, text_of
from .components import connected_components

PIVOTS = 16
REFERENCES = np.random.default_rng(64).integers(0, 2**64, PIVOTS, dtype=np.uint64, endpoint=False)
LARGE_GROUP = 4096
PAIRS_AT_ONCE = 1 << 20


def fingerprint(text: str, shingle: int = 3) -> int:
    words = text.encode().lower().split()  # both for ASCII only: A-Z, and the six white-space bytes
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[i : j - 1], 42) for i, j in zip([0, *ends], ends[shingle - 1 :])], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    lanes = hashes.view(np.uint8).reshape(-1, 8)  # little-endian bytes
    if len(hashes) < 256:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, row_no: Column | None = None) -> DataFrame:
    """doc_id, row_no, fp (long, the fingerprint's bits) of every row; a null text counts as empty.

    row_no tells rows apart; by default they are numbered. Texts are read whole, one at a time. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for names, texts in in_parts(batch):
                fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                rows = batch.column(2).slice(lo, len(texts))
                lo += len(texts)
                yield pa.RecordBatch.from_arrays([names, rows, pa.array(fps)], ["doc_id", "row_no", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), (F.monotonically_increasing_id() if row_no is None else row_no).alias("row_no"))
    return rows.mapInArrow(run, "doc_id long, row_no long, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each reference, one row a fingerprint."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def links_within(fps: np.ndarray, table: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indexes whose links connect, in each group, all that links of at most `bits` bits connect.

    group holds ascending numbers. In each round every group takes one member, a linked one that has not been compared
    yet if there is any, and compares it with the members that nothing has linked so far; those it links are connected
    and need no comparison with each other. A group is over when no such member is left.
    """
    fresh, linked, done = 0, 1, 2
    at, state = np.arange(len(fps)), np.zeros(len(fps), np.int8)
    out_a, out_b = [], []
    while len(at):
        own = group[at]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(first, len(at)))
        left = np.add.reduceat((state[at] == fresh).astype(np.int64), first)
        queued = np.add.reduceat((state[at] == linked).astype(np.int64), first)
        go = np.repeat(left + (queued > 0) > 1, count)
        if not go.all():
            at = at[go]
            continue
        # a linked member comes before a fresh one
        order = np.where(state[at] == linked, 0, len(at)) + np.arange(len(at))
        lead = at[np.minimum.reduceat(order, first) % len(at)]
        state[lead] = done
        a, b = at, np.repeat(lead, count)
        test = state[a] == fresh
        a, b = a[test], b[test]
        near = np.abs(table[a] - table[b]).max(axis=1) <= bits
        a, b = a[near], b[near]
        good = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        a, b = a[good], b[good]
        state[a] = linked
        out_a.append(a)
        out_b.append(b)
        at = at[state[at] != done]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def split_masks(mask: int, parts: int) -> list[int]:
    """The mask with each of `parts` shares of its other bits added."""
    other = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in other[len(other) * k // parts : len(other) * (k + 1) // parts]) for k in range(parts)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def link_edges(fps: DataFrame, bits: int = 2, large: int = LARGE_GROUP) -> DataFrame:
    """a, b: links that connect what links of at most `bits` bits connect. fps has distinct values in its column fp."""
    quarters = [0xFFFF << (16 * k) for k in range(4)]
    masks = [quarters[i] | quarters[j] for i in range(4) for j in range(i)] if bits == 2 else [0]
    own = lambda ms: F.explode(F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for m in ms]))
    keyed = fps.select("fp", own(masks).alias("k")).select("k.mask", "k.value", "fp")
    small = None
    for _ in range(2):
        big = materialize(keyed.groupBy("mask", "value").count().filter(F.col("count") > large), "large-groups")
        if big.isEmpty():
            break
        # Splitting leaves 21 free bits in each group, then 14: at most 16,384 members, whatever the input.
        rest = keyed.join(big, ["mask", "value"], "left_anti")
        small = rest if small is None else small.unionByName(rest)
        parts = None
        for m in masks:
            part = keyed.join(big, ["mask", "value"], "left_semi").filter(F.col("mask") == F.lit(signed(m))).select("fp", own(split_masks(m, bits + 1)).alias("k"))
            parts = part if parts is None else parts.unionByName(part)
        masks = [x for m in masks for x in split_masks(m, bits + 1)]
        keyed = parts.select("k.mask", "k.value", "fp")
    keyed = keyed if small is None else small.unionByName(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def work(mask, value, fp):
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
            group = np.cumsum(new)
            many = np.bincount(group)[group] > 1
            fp, group = fp[many].view(np.uint64), group[many]
            a, b = links_within(fp, pivot_table(fp), group, bits)
            return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            mask, value, fp = held
            if len(fp) < 2 * large:
                continue
            last = int(np.flatnonzero((mask == mask[-1]) & (value == value[-1]))[0])  # this group may go on
            if last:
                yield work(mask[:last], value[:last], fp[:last])
                held = [h[last:] for h in held]
        if len(held[2]):
            yield work(*held)

    return keyed.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(rows: DataFrame, bits: int = 2) -> DataFrame:
    """doc_id, row_no, fp, component_id, keep of every row of rows (doc_id, row_no, fp).

    component_id is the smallest doc_id that can be reached over links of at most `bits` bits; null identifiers come
    last. keep marks one row of each component, the one of that identifier (of several, the one of smallest row_no).
    """
    groups = materialize(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_no")).alias("least"), F.count("*").alias("n")), "fingerprints")
    nodes = materialize(connected_components(link_edges(groups.select("fp"), bits)), "components")
    inside = nodes.select(F.col("node").alias("fp"), "component").join(groups, "fp")
    best = inside.groupBy("component").agg(F.min("least").alias("best"), F.count("*").alias("size"))
    of_linked = join_hot(inside.select("fp", "component", "n"), best, ["component"], "size").select("fp", "best", "n")
    alone = groups.join(nodes.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("least").alias("best"), "n")
    found = materialize(of_linked.unionByName(alone), "of-fingerprint")
    return join_hot(rows, found, ["fp"], "n").select("doc_id", "row_no", "fp", F.col("best.doc_id").alias("component_id"), (F.col("row_no") == F.col("best.row_no")).alias("keep"))


def survivors(pairs: DataFrame, bits: int) -> DataFrame:
    """a, b of the pairs (a, b, fa, fb) whose fingerprints differ in at most `bits` bits, after the pivot filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fa, fb = (batch.column(c).to_numpy().view(np.uint64) for c in ("fa", "fb"))
            at = np.flatnonzero(np.abs(pivot_table(fa) - pivot_table(fb)).max(axis=1, initial=0) <= bits)
            at = at[np.bitwise_count(fa[at] ^ fb[at]) <= bits]
            yield batch.select(["a", "b"]).take(pa.array(at))

    return pairs.select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group of texts whose five-word shingles have a similarity of 0.8 or more (see near.py)."""
    from .near import drop_near_copies

    return drop_near_copies(docs, id_col, text_col)
