"""Where strings of a fixed length recur, exactly, in a corpus of any size.

A string of `length` symbols (bytes or words) is represented by one of its own substrings of `gram` symbols, its
anchor: the leftmost one of least hash. Equal strings have equal anchors at the same distance, and overlapping strings
mostly share an anchor, so a text of n symbols has few anchors. The work then goes by anchor:

1. Around its anchor every string has `half` symbols on the left or on the right at least. Those stretches (anchor and
   left side, anchor and right side) are counted over all texts; a string one of whose stretches occurs once is unique.
2. What is needed to compare the strings that are left is sent to the anchor's shard. The stretches that recur are told
   apart by a bitmap sized by their number; where that would be too large to broadcast, by joins.
3. In each shard, the strings that recur are found by their symbols. Anchors that very many texts share are dealt to
   several shards. What is unique in one of those is compared again with what the anchor's other shards hold: strings go
   by blocks of neighbouring distances from the anchor, under the hash of the stretch that all strings of a block
   share, so equal strings meet; of a string that recurs in its shard one copy goes. Stretches that very many blocks
   share go string by string, and no more than one of each shard are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_parts
from .common import materialize, partitions, text_of

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
#: Bits of the broadcast bitmap at most (32 MB), and keys for which it is used at most; beyond them stretches are joined.
MOST_BITS, MOST_KEYS = 28, 1 << 26
SHARES = 4  #: an anchor is hot if it has more than 1 / (SHARES * partitions) of all counted stretches,
LEAST_HOT = 256  #: and as many as this
SHARD_BYTES = 1 << 18
BYTE_VALUES = np.random.default_rng(400).integers(1, 2**63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    for i, base in enumerate((BASE, UNBASE)):
        while len(_powers[i]) < n:
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(base, len(_powers[i]), 1 << 64))])
    return _powers


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(symbols * powers(len(symbols) + 1)[0][: len(symbols)])])


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the symbols from start to end, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


@dataclass
class Scan:
    """Texts of a batch as one row of symbols, with runs of strings that have the same anchor."""

    raw: np.ndarray  # bytes of all texts, a space before each and at the end; with words, one space between them
    offsets: np.ndarray  # of each text in symbols, and the end
    starts: np.ndarray  # of each symbol in raw,
    ends: np.ndarray  # and its end
    doc: np.ndarray  # of each run: its text,
    anchor: np.ndarray  # the hash of its anchor,
    place: np.ndarray  # where that begins,
    first: np.ndarray  # and the first and last of its strings, as symbol numbers
    last: np.ndarray
    left: np.ndarray  # keys of the anchor with its left and right side; 0 where no string of the run needs them
    right: np.ndarray


def scan(texts: list[str], length: int, gram: int, words: bool) -> Scan:
    coded = [t.encode() for t in texts]
    if words:
        coded = [b" ".join(c.split()) for c in coded]
    raw = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)
    borders = np.cumsum([1] + [len(c) + 1 for c in coded])
    if words:
        space = raw == 32
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        symbols = range_hashes(prefix_sums(BYTE_VALUES[raw]), starts, ends)
        offsets = np.searchsorted(starts, borders)
    else:
        starts = np.arange(len(raw))
        ends, symbols, offsets = starts + 1, BYTE_VALUES[raw], borders
    n, span = len(symbols), length - gram + 1
    at = np.zeros(0, np.int64)
    if n >= length:
        end = np.repeat(offsets[1:] - (0 if words else 1), np.diff(offsets))  # where each symbol's text ends
        at = np.arange(offsets[0], n - length + 1)
        at = at[at + length <= end[at - offsets[0]]]
    if not len(at):
        none, keys = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Scan(raw, offsets, starts, ends, none, keys, none, none, none, keys, keys)
    sums = prefix_sums(symbols)
    grams = range_hashes(sums, np.arange(n - gram + 1), np.arange(gram, n + 1))
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(keyed) % span
    tiles = np.concatenate([keyed, np.full(pad, ~np.uint64(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[span - 1 : span - 1 + n - length + 1])
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last, place = at[new], at[np.append(new[1:] - 1, len(at) - 1)], place[new]
    anchor, half = grams[place], (length - gram) // 2
    # the upper half of a key names the anchor, its last bit the side
    name = mix(anchor ^ np.uint64(BASE)) & np.uint64(0xFFFFFFFF00000000)
    stretch = lambda lo, hi: range_hashes(sums, np.maximum(lo, 0), np.minimum(hi, n)) >> np.uint64(32)
    left = np.where(first <= place - half, name | stretch(place - half, place + gram) & np.uint64(0xFFFFFFFE), np.uint64(0))
    right = np.where(last >= place - (length - gram - half), name | stretch(place, place + gram + half) | np.uint64(1), np.uint64(0))
    return Scan(raw, offsets, starts, ends, np.searchsorted(offsets, first, "right") - 1, anchor, place, first, last, left, right)


def trimmed(s: Scan, left: np.ndarray, right: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with strings that may recur, and the first and last such string of each; left and right say whose stretch recurs."""
    half = (length - gram) // 2
    lo = np.where(left, s.first, np.maximum(s.first, s.place - half + 1))
    hi = np.where(right, s.last, np.minimum(s.last, s.place - (length - gram - half) - 1))
    own = np.flatnonzero((left | right) & (lo <= hi))
    return own, lo[own], hi[own]


def keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """docs with the columns k1 and k2, which name a row wherever it is read again, and its text."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1), "doc_id")})


def bitmap_of(keys: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, those of the keys set: at most 2**(MOST_BITS - 6) words reach the driver, whatever the input."""
    at = F.shiftrightunsigned(F.xxhash64("key"), 64 - bits)
    rows = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def xxhash64(keys: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of long values (XXH64 of 8 bytes, seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turn(keys * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


RUNS = "g long, salt int, lead int, k1 long, k2 long, first long, payload binary"


def recurring_spans(docs: DataFrame, length: int, gram: int, words: bool, recurring: Callable[[list[bytes]], list[np.ndarray]]) -> DataFrame:
    """k1, k2, spans (array of start, stop, in symbols) of every row of docs (see keyed) with a string that recurs.

    recurring gets the stretches of text of a shard, and says of each which of its strings recur in the shard.
    """
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in in_parts(batch):
                s = scan(texts, length, gram, words)
                key, n = np.unique(np.concatenate([s.left[s.left > 0], s.right[s.right > 0]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    keys = docs.select("k1", "text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    keys = materialize(keys, "stretches")
    n_keys, total = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = max(LEAST_HOT, -(-total // (SHARES * partitions(spark))))
    most = keys.groupBy(F.shiftright("key", 32).alias("name")).agg(F.sum("n").alias("n")).filter(F.col("n") > limit).collect()  # fewer than SHARES * partitions
    names = np.array(sorted((r.name, -(-r.n // limit)) for r in most), np.int64).reshape(-1, 2)

    def send(s: Scan, k1: np.ndarray, k2: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        whole = s.raw.tobytes()
        payload = [whole[a:b] for a, b in zip(s.starts[lo].tolist(), s.ends[hi + length - 1].tolist(), strict=True)]
        doc, g, first = s.doc[own], s.anchor[own], lo - s.offsets[s.doc[own]]
        name = (mix(g ^ np.uint64(BASE)).view(np.int64)) >> 32
        salt = np.zeros(len(own), np.int64)
        if len(names) and len(own):
            at = np.minimum(np.searchsorted(names[:, 0], name), len(names) - 1)
            of = np.where(names[at, 0] == name, names[at, 1], 0)
            salt = np.where(of > 0, 1 + (mix(k1[doc].view(np.uint64) ^ first.astype(np.uint64)) % np.maximum(of, 1).astype(np.uint64)).astype(np.int64), 0)
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(salt, pa.int32()), pa.array(s.place[own] - lo, pa.int32()), pa.array(k1[doc]), pa.array(k2[doc]), pa.array(first, pa.int64()), pa.array(payload, pa.binary())], [x.split()[0] for x in RUNS.split(", ")])

    if n_keys <= MOST_KEYS:
        bits = min(MOST_BITS, max(10, int(16 * max(n_keys, 1)).bit_length()))
        held = spark.sparkContext.broadcast(bitmap_of(keys, bits))  # bounded by MOST_BITS

        def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def there(key: np.ndarray) -> np.ndarray:
                bit = xxhash64(key) >> np.uint64(64 - bits)
                return (key > 0) & ((held.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)

            for batch in batches:
                lo = 0
                for k1, texts in in_parts(batch):
                    k2 = batch.column(2).slice(lo, len(texts)).to_numpy()
                    lo += len(texts)
                    s = scan(texts, length, gram, words)
                    yield send(s, k1.to_numpy(), k2, *trimmed(s, there(s.left), there(s.right), length, gram))

        sent = docs.select("k1", "text", "k2").mapInArrow(filtered, RUNS)
    else:
        sent = by_joins(docs, keys, length, gram, words, send)

    block = max(1, length // 12)

    def again_rows(g, payload, lead, first, k1, k2, own, flags) -> Iterator[tuple]:
        """Blocks of the strings of one shard of a hot anchor: those that it has once, and one copy of the others."""
        seen: set[bytes] = set()
        texts: set[bytes] = set()
        for i in own:
            text = payload[i]
            if text in texts:
                continue
            texts.add(text)
            starts, ends = symbol_bounds(text, words)
            need = ~flags[i]
            for t in np.flatnonzero(flags[i]).tolist():
                string = text[starts[t] : ends[t + length - 1]]
                if string not in seen:
                    seen.add(string)
                    need[t] = True
            away = lead[i] - np.arange(len(need))
            at = np.flatnonzero(need)
            if not len(at):
                continue
            of = away[at] // block
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() + [len(at)]
            for a, b in zip(cuts, cuts[1:]):
                lo, hi, j = int(at[a]), int(at[b - 1]), int(of[a])
                core = text[starts[lead[i] - j * block] : ends[lead[i] - j * block - block + length]]
                mask = sum(1 << int(x - lo) for x in at[a:b])
                yield hash_of(g + j, core), mask, k1[i], k2[i], int(first[i]) + lo, text[starts[lo] : ends[hi + length - 1]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            payload = table["payload"].to_pylist()
            g, salt, lead, k1, k2, first = (table[c].to_numpy() for c in ("g", "salt", "lead", "k1", "k2", "first"))
            flags = recurring(payload)
            yield spans_of(k1, k2, first, flags, length)
            groups: dict[tuple[int, int], list[int]] = {}
            for i in np.flatnonzero(salt > 0).tolist():
                groups.setdefault((int(g[i]), int(salt[i])), []).append(i)
            for (x, _), own in groups.items():
                rows = list(again_rows(x, payload, lead, first, k1, k2, own, flags))
                if rows:
                    key, mask, a, b, at, text = zip(*rows, strict=True)
                    none = pa.nulls(len(key), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(at, pa.int64()), none, pa.array(key, pa.int64()), pa.array(mask, pa.int64()), pa.array(text, pa.binary())], FOUND)

        yield from in_shards(batches, ("g", "salt"), work)

    def compare_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            k1, k2, first = (table[c].to_numpy() for c in ("k1", "k2", "first"))
            yield spans_of(k1, k2, first, recurring(table["payload"].to_pylist()), length)

        yield from in_shards(batches, ("key",), work)

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, first, mask, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "first", "mask", "payload")), strict=True):
                starts, ends = symbol_bounds(text, words)
                for t in range(len(starts) - length + 1):
                    if mask >> t & 1:
                        string = text[starts[t] : ends[t + length - 1]]
                        out.append((k1, k2, first + t, hash_of(0, string), string))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["k1", "k2", "first", "key", "payload"])

    sent = sent.repartition("g", "salt").sortWithinPartitions("g", "salt")
    found = materialize(sent.mapInArrow(compare, FOUND_TYPES), "recurring")
    spans = found.filter("stop IS NOT NULL").select("k1", "k2", "start", "stop")
    if len(names):
        again = found.filter("stop IS NULL").select("k1", "k2", F.col("start").alias("first"), "key", "mask", "payload")
        counts = materialize(again.groupBy("key").count(), "again")
        bound = max(LEAST_HOT, -(-(counts.agg(F.sum("count")).first()[0] or 0) // (SHARES * partitions(spark))))
        large = F.broadcast(counts.filter(F.col("count") > bound).select("key"))  # fewer than SHARES * partitions
        rows = again.join(large, "key", "left_anti").select("k1", "k2", "first", "key", "payload")
        rows = rows.unionByName(again.join(large, "key", "left_semi").select("k1", "k2", "first", "mask", "payload").mapInArrow(one_by_one, "k1 long, k2 long, first long, key long, payload binary"))
        more = rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare_again, FOUND_TYPES)
        spans = spans.unionByName(more.select("k1", "k2", "start", "stop"))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def by_joins(docs: DataFrame, keys: DataFrame, length: int, gram: int, words: bool, send) -> DataFrame:
    """What the bitmap does, without a broadcast: runs are joined with the stretches that recur, and what is left with its text."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for k1, texts in in_parts(batch):
                k2 = batch.column(2).slice(lo, len(texts)).to_numpy()
                lo += len(texts)
                s = scan(texts, length, gram, words)
                at = s.first - s.offsets[s.doc]
                for key, side in ((s.left, 1), (s.right, 2)):
                    own = np.flatnonzero(key)
                    yield pa.RecordBatch.from_arrays([pa.array(k1.to_numpy()[s.doc[own]]), pa.array(k2[s.doc[own]]), pa.array(at[own]), pa.array(np.full(len(own), side, np.int32)), pa.array(key[own].view(np.int64))], ["k1", "k2", "at", "side", "key"])

    kept = docs.select("k1", "text", "k2").mapInArrow(runs, "k1 long, k2 long, at long, side int, key long").join(keys.select("key"), "key", "left_semi")
    lists = kept.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "side")).alias("runs"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for k1, texts in in_parts(batch):
                part = batch.slice(lo, len(texts))
                lo += len(texts)
                s = scan(texts, length, gram, words)
                left, right = np.zeros(len(s.first), bool), np.zeros(len(s.first), bool)
                wanted = {(i, x["at"], x["side"]) for i, own in enumerate(part.column(3).to_pylist()) for x in own}
                for i, (d, at) in enumerate(zip(s.doc.tolist(), (s.first - s.offsets[s.doc]).tolist(), strict=True)):
                    left[i], right[i] = (d, at, 1) in wanted, (d, at, 2) in wanted
                yield send(s, k1.to_numpy(), part.column(2).to_numpy(), *trimmed(s, left, right, length, gram))

    return docs.select("k1", "k2", "text").join(lists, ["k1", "k2"]).select("k1", "text", "k2", "runs").mapInArrow(chosen, RUNS)


def symbol_bounds(text: bytes, words: bool) -> tuple[list[int], list[int]]:
    if not words:
        return range(len(text)), range(1, len(text) + 1)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
    return [0, *(x + 1 for x in gaps)], [*gaps, len(text)]


def hash_of(seed: int, text: bytes) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(text, seed & (2**64 - 1))
    return x - (1 << 64) if x >> 63 else x


FOUND_TYPES = "k1 long, k2 long, start long, stop long, key long, mask long, payload binary"
FOUND = [x.split()[0] for x in FOUND_TYPES.split(", ")]


def spans_of(k1: np.ndarray, k2: np.ndarray, first: np.ndarray, flags: list[np.ndarray], length: int) -> pa.RecordBatch:
    """The maximal runs of flagged strings; one entry of k1, k2, first and flags for each stretch of text."""
    counts = np.array([len(f) for f in flags])
    of = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + first[of]
    on = np.flatnonzero(np.concatenate(flags))
    new = np.flatnonzero(np.concatenate([[True], (of[on[1:]] != of[on[:-1]]) | (pos[on[1:]] != pos[on[:-1]] + 1)])) if len(on) else on
    a, b = on[new], on[np.append(new[1:] - 1, len(on) - 1)] if len(on) else on
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(k1[of[a]]), pa.array(k2[of[a]]), pa.array(pos[a], pa.int64()), pa.array(pos[b] + length, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], FOUND)


def in_shards(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], work) -> Iterator[pa.RecordBatch]:
    """work on tables of whole groups (rows come sorted by the named columns) of about SHARD_BYTES together."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lo = 0
        payload = batch.column("payload")
        sizes = np.diff(np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + batch.num_rows + 1])
        columns = [batch.column(c).to_numpy() for c in names]
        if held and size >= SHARD_BYTES and any(held[-1].column(c)[-1].as_py() != x[0] for c, x in zip(names, columns, strict=True)):
            yield from work(pa.Table.from_batches(held))
            held, size = [], 0
        borders = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
        upto = np.concatenate([[0], np.cumsum(sizes)])
        for at in borders.tolist():
            if size + upto[at] - upto[lo] >= SHARD_BYTES:
                yield from work(pa.Table.from_batches([*held, batch.slice(lo, at - lo)]))
                held, size, lo = [], 0, at
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
            size += int(upto[-1] - upto[lo])
    if held:
        yield from work(pa.Table.from_batches(held))


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (rows of start, stop) in order, with those that overlap or touch put together."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    upto = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > upto[:-1]]))
    return np.stack([spans[new, 0], upto[np.append(new[1:] - 1, len(spans) - 1)]], axis=1)
