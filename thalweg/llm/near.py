"""Near copies by SimHash fingerprints: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity two 64-bit fingerprints differ in 9.7 bits on average (a bit differs with a probability of 0.15, in
sets of a few shingles up to 0.2). Candidates come from the fingerprints first: those that differ in at most BITS bits
are found by the blocks of bits and pivot tables of simhash.link_edges. No blocks of bits find pairs much farther apart
among many texts, so such pairs come from BANDS keys a text, each over ROWS minima of differently hashed shingles: a pair
of similarity s shares no key with probability (1 - s**ROWS)**BANDS, 5e-5 at 0.8 and 4e-7 at 0.85. Pairs whose pivot distances differ by more
than MOST_BITS in a coordinate, or whose fingerprints do, are discarded (by calculation, at most one linked pair in a
million). What survives is verified on the shingle sets
themselves. First all members of a key are compared with its least member. Where that leaves a key's members in several
components, the pairs across them are compared in keys of at most LARGE members. Larger ones that share members form a
family, whose sets are dealt to tiles of bounded size: tiles meet in a task, where one product of 0/1 matrices counts
what every two of their sets have in common, and only links leave it. Members of a family's largest component, by then
most of a group of copies, are compared with the others but not with each other, and no row exists for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .blocks import packed
from .bpe import in_parts
from .common import fresh, join_hot, materialize, text_of
from .components import connected_components
from .simhash import link_edges, majority, pivot_table, survivors

SHINGLE = 5
BITS = 2
BANDS, ROWS = 25, 5
FACTORS, SHIFTS = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64, endpoint=False)
FACTORS |= np.uint64(1)
AT_ONCE = PLACE_ROWS = 1024
MOST_BITS = 28
LARGE = 32
#: Sets and shingles of a tile at most, on average; columns of the matrices that count what two tiles share.
TILE_SETS, TILE_SHINGLES, COLUMNS = 512, 1 << 17, 8192


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the text's five-word shingles; of a shorter text, that of all its words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[i : j - 1], 42) for i, j in zip([0, *ends], ends[SHINGLE - 1 :])], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    if not len(hashes):
        return []
    least = np.min([(hashes[i : i + AT_ONCE, None] * FACTORS + SHIFTS).min(axis=0) for i in range(0, len(hashes), AT_ONCE)], axis=0)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def among(nodes: DataFrame):
    """A test whether nodes (an array) are in the table: yes for all that are, and for few others; without a shuffle.

    Its bitmap is sized by their number and bounded; for more nodes than that allows for it says yes to all.
    """
    n = nodes.count()
    if n > repeats.MOST_KEYS:
        return lambda x: np.ones(len(x), bool)
    bits = min(repeats.MOST_BITS, max(10, int(16 * max(n, 1)).bit_length()))
    held = nodes.sparkSession.sparkContext.broadcast(repeats.bitmap_of(nodes.select(F.col("node").alias("key")), bits))

    def test(x: np.ndarray) -> np.ndarray:
        bit = repeats.xxhash64(x.view(np.uint64)) >> np.uint64(64 - bits)
        return ((held.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)

    return test


def of_texts(docs: DataFrame, make, name: str, test=None) -> DataFrame:
    """node, doc_id, n (distinct shingles), fp (their fingerprint) and the list make(hashes) of every row of docs (doc_id, text, node), or of those whose node passes the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if test is not None:
                batch = batch.filter(pa.array(test(batch.column(2).to_numpy())))
            lo = 0
            for names, texts in in_parts(batch, 1 << 19):
                sets = [shingles(t) for t in texts]
                lists = [np.array(make(s), np.uint64).view(np.int64) for s in sets]
                rows = batch.column(2).slice(lo, len(texts))
                lo += len(texts)
                fps = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows, names, pa.array([len(s) for s in sets], pa.int32()), pa.array(fps), pa.array(lists, pa.list_(pa.int64()))], ["node", "doc_id", "n", "fp", name])

    return docs.select("doc_id", "text", "node").mapInArrow(run, f"node long, doc_id long, n int, fp long, {name} array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, own (its shingles) of the wanted nodes; the texts of the others stay where they are."""
    sets = of_texts(docs, lambda s: s, "own", among(wanted)).select("node", "own")
    return materialize(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "near-sets")


def join_salted(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of many rows to one wide row per key: a key of more than PLACE_ROWS rows is dealt to several places, with a copy of its wide row at each.

    Only the number of places of such keys is broadcast, where Spark finds that table small enough.
    """
    places = groups.filter(F.col(size) > PLACE_ROWS).select(key, F.ceil(F.col(size) / PLACE_ROWS).cast("int").alias("places"))
    dealt = rows.join(places, key, "left").withColumn("place", F.when(F.col("places").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("places"))).cast("int"))
    wide = groups.withColumn("place", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col(size) / PLACE_ROWS)).cast("int") - 1)))
    wide = wide.withColumn("place", F.when(F.col(size) > PLACE_ROWS, F.col("place")).otherwise(0))
    return dealt.drop("places").join(wide.drop(size), [key, "place"]).drop("place")


def similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) with their Jaccard distance, and whether their similarity is 0.8 or more (linked)."""
    wanted = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "near-wanted")
    sets = sets_of(docs, wanted)
    rows = pairs
    for end in ("a", "b"):
        side = pairs.groupBy(end).count().join(sets.select(F.col("node").alias(end), F.col("own").alias(f"set_{end}")), end)
        rows = join_salted(rows, side, end, "count")
    both = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b")
    return rows.select("a", "b", (9 * both >= 4 * total).alias("linked"), (1 - both / (total - both)).alias("apart"))  # 0.8 without division


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each set of b."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(np.unique(flat_a), np.unique(flat_b), assume_unique=True)

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, flat)
        held = np.flatnonzero(at < len(shared))
        held = held[shared[at[held]] == flat[held]]
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[held], at[held]

    (row_a, at_a), (row_b, at_b) = places(flat_a, a), places(flat_b, b)
    out = np.zeros((len(a), len(b)), np.float32)  # exact: sets share fewer than 2**24
    for lo in range(0, len(shared), COLUMNS):
        grids = []
        for rows, at, n in ((row_a, at_a, len(a)), (row_b, at_b, len(b))):
            grid = np.zeros((n, min(COLUMNS, len(shared) - lo)), np.float32)
            inside = (at >= lo) & (at < lo + COLUMNS)
            grid[rows[inside], at[inside] - lo] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def tile_links(table: pa.Table) -> pa.RecordBatch:
    """Links between the two sides of a pair of tiles, at most one from a node to a component: enough to connect them."""
    side = table["side"].to_numpy()
    nodes, fps, groups = (table[c].to_numpy() for c in ("node", "fp", "component"))
    sets = [x.values.to_numpy().view(np.uint64) for x in table["own"]]
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    fps = fps.view(np.uint64)
    far = (pivot_table(fps[a])[:, None] - pivot_table(fps[b])[None]).max(axis=2, initial=0) > MOST_BITS if len(a) and len(b) else np.ones((len(a), len(b)), bool)
    test = ~far & (groups[a][:, None] != groups[b]) & (np.bitwise_count(fps[a][:, None] ^ fps[b]) <= MOST_BITS)
    a, b, test = a[test.any(axis=1)], b[test.any(axis=0)], test[test.any(axis=1)][:, test.any(axis=0)]
    out = np.zeros((0, 2), np.int64)
    if test.any():
        size = np.array([len(s) for s in sets])
        common = common_counts([sets[i] for i in a], [sets[i] for i in b]).astype(np.int64)
        at_a, at_b = np.nonzero(test & (9 * common >= 4 * (size[a][:, None] + size[b])))
        first = np.unique(np.stack([at_a, groups[b][at_b]], axis=1), axis=0, return_index=True)[1]
        out = np.stack([nodes[a[at_a[first]]], nodes[b[at_b[first]]]], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(out.max(axis=1, initial=-(1 << 63))), pa.array(out.min(axis=1, initial=(1 << 63) - 1))], ["a", "b"])


def families_of(members: DataFrame) -> DataFrame:
    """node, family of members (key, node): every key lies in one family, and keys that share members mostly in the same.

    A key is named by its least node, then twice by the least name among the keys of its members; a node whose keys got
    different names belongs to several families.
    """
    names = members.groupBy("key").agg(F.min("node").alias("family"))
    for _ in range(2):
        of_nodes = members.join(names, "key").groupBy("node").agg(F.min("family").alias("family"))
        names = materialize(members.join(of_nodes, "node").groupBy("key").agg(F.min("family").alias("family")), "near-names")
    return members.join(names, "key").select("node", "family").distinct()


def family_links(members: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links that connect all links between different components in each family.

    members has key and node: all nodes of a key share a family. nodes has node, n, fp, component of each once.
    """
    held = materialize(families_of(members).join(nodes, "node"), "near-family")
    of_component = held.groupBy("family", "component").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    sums = of_component.groupBy("family").agg(F.max(F.struct("nodes", "shingles", "component")).alias("top"), F.sum("nodes").alias("size"), F.sum("shingles").alias("shingles"))
    tiles = lambda n, k: F.greatest(F.ceil(n / TILE_SETS), F.ceil(k / TILE_SHINGLES)).cast("int")
    minor = tiles(F.col("size") - F.col("top.nodes"), F.col("shingles") - F.col("top.shingles"))
    sums = sums.select("family", "size", F.col("top.component").alias("major"), tiles(F.col("size"), F.col("shingles")).alias("all_tiles"), minor.alias("minor_tiles"))
    placed = materialize(join_hot(held, materialize(sums.filter("minor_tiles > 0"), "near-tiles"), ["family"], "size"), "near-placed")
    sets = sets_of(docs, placed.select("node"))
    deal = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = placed.filter("component <> major").select("family", deal("minor_tiles").alias("i"), every("all_tiles").alias("j"), F.lit(0).alias("side"), "node", "fp", "component")
    right = placed.select("family", every("minor_tiles").alias("i"), deal("all_tiles").alias("j"), F.lit(1).alias("side"), "node", "fp", "component")
    rows = left.unionByName(right).join(sets, "node")
    return packed(rows.select("family", "i", "j", "side", "node", "fp", "component", "own"), ["family", "i", "j"], ["side", "node"], tile_links, "a long, b long")


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """a, b, fa, fb: pairs of nodes (a the larger) that connect all rows (node, n, fp) whose fingerprints differ in at most BITS bits.

    Rows of equal fingerprints are paired with the least of them, which stands for them in pairs of different ones.
    Texts without words resemble none.
    """
    rows = rows.filter("n > 0").select("node", "fp")
    least = materialize(rows.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("size")), "near-fingerprints")
    equal = join_hot(rows, least.filter("size > 1"), ["fp"], "size").filter("node <> least").select(F.col("node").alias("x"), F.col("least").alias("y"), F.col("fp").alias("fx"), F.col("fp").alias("fy"))
    links = link_edges(least.select("fp"), BITS).distinct().withColumnsRenamed({"a": "fx", "b": "fy"})
    for end in ("x", "y"):
        links = links.join(least.select(F.col("fp").alias(f"f{end}"), F.col("least").alias(end)), f"f{end}")
    pairs, first = equal.unionByName(links), F.col("x") > F.col("y")
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), F.when(first, F.col("fx")).otherwise(F.col("fy")).alias("fa"), F.when(first, F.col("fy")).otherwise(F.col("fx")).alias("fb"))


def near_components(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """node, component of the rows (node, n, fp, keys) that are linked to another by a similarity of 0.8 or more."""
    members = rows.select("node", "n", "fp", F.explode("keys").alias("key"))
    groups = materialize(members.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "fp")).alias("least")).filter("size > 1"), "near-groups")
    held = materialize(join_hot(members, groups, ["key"], "size").select("key", "node", "n", "fp", "least"), "near-members")
    stars = held.filter("node <> least.node").select(F.col("node").alias("a"), F.col("least.node").alias("b"), F.col("fp").alias("fa"), F.col("least.fp").alias("fb"))
    stars = materialize(survivors(fingerprint_pairs(rows).unionByName(stars).distinct(), MOST_BITS), "near-pairs")
    measured = materialize(similar(stars, docs), "near-links")
    links = measured.filter("linked").select("a", "b")
    first = materialize(connected_components(links), "near-components")
    # Jaccard distance is a metric: what lies 0.2 nearer to a key's least member than another member is no link of it
    at = measured.select(F.col("a").alias("node"), F.struct(F.col("b").alias("node")).alias("least"), "apart")
    known = held.withColumn("least", F.struct("least.node")).join(first, "node", "left").join(at, ["node", "least"], "left")
    apart = F.when(F.col("node") == F.col("least.node"), F.lit(0.0)).otherwise(F.col("apart"))
    known = materialize(known.select("key", "node", "n", "fp", apart.alias("apart"), F.coalesce("component", "node").alias("component")), "near-known")
    sizes = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    sizes = materialize(sizes.filter("lo <> hi AND size > 2").select("key", "size"), "near-split")
    rest = known.join(sizes.filter(F.col("size") <= LARGE).select("key"), "key", "left_semi")
    other = rest.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("fp").alias("fb"), F.col("apart").alias("apart_b"), F.col("component").alias("of_b"))
    across = rest.join(other, "key").filter("component > of_b AND 5 * n >= 4 * m AND 5 * m >= 4 * n AND (apart IS NULL OR apart_b IS NULL OR abs(apart - apart_b) <= 0.2000001)")
    across = across.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"), F.when(F.col("node") > F.col("b"), F.col("fp")).otherwise(F.col("fb")).alias("fa"), F.when(F.col("node") > F.col("b"), F.col("fb")).otherwise(F.col("fp")).alias("fb"))
    linked = None
    many = sizes.filter(F.col("size") > LARGE)
    if not many.isEmpty():
        inside = materialize(join_hot(known, many, ["key"], "size").select("key", "node", "n", "fp", "component"), "near-large")
        linked = materialize(family_links(inside.select("key", "node"), inside.select("node", "n", "fp", "component").distinct(), docs), "near-across")
    # stars run from the larger node to the smaller
    pairs = materialize(survivors(across.distinct(), MOST_BITS).join(stars, ["a", "b"], "left_anti"), "near-pairs")
    more = linked
    if not pairs.isEmpty():
        found = similar(pairs, docs).filter("linked").select("a", "b")
        more = found if linked is None else found.unionByName(linked)
    if more is None:
        return first
    return materialize(connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "near-components")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each component: that of its smallest identifier; null identifiers come last."""
    key = F.xxhash64(F.col(id_col).cast("long"), text_of(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), key.alias("node"))
    rows = materialize(of_texts(texts, band_keys, "keys"), "near-keys")
    twins = materialize(rows.groupBy("node").count().filter("count > 1").select("node"), "near-twins")  # repeated rows, of which one stays
    whole = rows if twins.isEmpty() else rows.dropDuplicates(["node"])
    nodes = near_components(whole, texts)
    inside = nodes.join(whole.select("node", "doc_id"), "node")
    best = inside.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node")).alias("b")).select("b.node")
    lost = materialize(nodes.select("node").join(best, "node", "left_anti"), "near-lost")
    name = fresh(docs, "node")
    held = docs.withColumn(name, key)
    test, at = among(materialize(lost.unionByName(twins).distinct(), "near-odd")), len(docs.columns)

    def part(odd: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(test(batch.column(at).to_numpy()) == odd))

        return held.mapInArrow(run, held.schema)

    again = part(True).join(lost.withColumnRenamed("node", name), name, "left_anti").dropDuplicates([name])
    return part(False).unionByName(again.select(*held.columns)).drop(name)
