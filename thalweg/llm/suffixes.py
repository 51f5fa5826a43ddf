"""Suffix-array deduplication with the difference-cover algorithm.

Two equal strings of 400 bytes have the same anchor (see repeats.py), so the anchors deal the corpus out to shards in
which all strings that can be equal lie together; texts that stand in a shard more than once are sorted once. The
suffixes are thus put in order shard by shard, not in one order of the whole corpus, whose triples and names would move
some forty times the input through shuffles. Each shard's suffix array is built by the difference-cover algorithm modulo 3: the sampled suffixes (positions 1 and 2
modulo 3) are sorted by their triples, the names of the triples form a string that is sorted recursively, the remaining
suffixes follow by their first byte and the rank of the next one, and both orders are merged. Strings recur where a
suffix shares 400 bytes with a neighbour in the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import in_parts
from .repeats import keyed, merged, recurring_spans

SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def order_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of keys below 2**bits; key and place are sorted as one number where both fit into it."""
    place = max(1, int(len(keys) - 1).bit_length())
    if bits + place > 63:
        return np.argsort(keys, kind="stable")
    return np.sort(keys << place | np.arange(len(keys))) & ((1 << place) - 1)


def names_of(keys: np.ndarray, bits: int = 63) -> tuple[np.ndarray, int]:
    """Ranks of the keys (below 2**bits), from 1, equal keys alike; and how many there are."""
    order = order_of(keys, bits)
    held = keys[order]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(np.concatenate([[1], held[1:] != held[:-1]]))
    return names, int(names[order[-1]])


def own_ranks(held: np.ndarray) -> np.ndarray:
    """How many of a sorted array's values are less than each."""
    return np.maximum.accumulate(np.where(np.concatenate([[True], held[1:] != held[:-1]]), np.arange(len(held)), 0))


def width(x: np.ndarray | int) -> int:
    return max(1, int(np.max(x)).bit_length())


def triple_names(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    w = width(t)
    if 3 * w + width(len(at)) <= 63:
        return names_of(t[at] << 2 * w | t[at + 1] << w | t[at + 2], 3 * w)
    pair, n = names_of(t[at] << w | t[at + 1], 2 * w)
    return names_of(pair << w | t[at + 2], width(n) + w)


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of s (values from 1 on) in an order that holds for their first `depth` symbols at least.

    A suffix that differs from two others in those symbols, where the two agree, never stands between them.
    """
    n = len(s)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    zeros, first, second = (np.arange(k, n, 3) for k in range(3))
    if n % 3 == 1:
        first = np.append(first, n)  # an empty suffix, which ends the first half of the names
    sample = np.concatenate([first, second])
    if not len(sample):
        return np.ones(n, np.int64)
    names, distinct = triple_names(t, sample)
    if distinct < len(names) and depth > 3:
        names = suffix_ranks(names, -(-depth // 3))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    t = np.append(t, 0)
    # suffixes of the first two kinds compare by one symbol and the rank behind it, of the first and third kind by two
    w, v = width(t), width(rank)
    one = lambda i: t[i] << v | rank[i + 1]
    both, n_both = names_of(np.concatenate([t[zeros] << w | t[zeros + 1], t[second] << w | t[second + 1]]), 2 * w)
    two = lambda pair, i: pair << v | rank[i + 2]
    # all in their own order, so that look-ups in a sorted array walk through it once
    of_zero = order_of(one(zeros), w + v)
    of_first, of_second = (x[order_of(rank[x], v)] for x in (first, second))
    zero_one, zero_two = one(zeros)[of_zero], two(both[: len(zeros)], zeros)[of_zero]
    pair_of = np.zeros(n + 3, np.int64)
    pair_of[second] = both[len(zeros) :]
    first_one, second_two = one(of_first), two(pair_of[of_second], of_second)
    sorted_first, sorted_second, sorted_zero_two = np.sort(first_one), np.sort(second_two), np.sort(zero_two)
    before = np.concatenate([[0], np.cumsum(np.bincount(names))])  # samples of a smaller name
    out = np.zeros(n + 1, np.int64)  # how many suffixes come before each
    out[zeros[of_zero]] = own_ranks(zero_one) + np.searchsorted(sorted_first, zero_one) + np.searchsorted(sorted_second, zero_two)
    out[of_first] = before[rank[of_first]] + np.searchsorted(zero_one, first_one)
    out[of_second] = before[rank[of_second]] + np.searchsorted(sorted_zero_two, second_two)
    return out[:n] + 1


def equal_prefixes(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which pairs of suffixes agree in their first `length` bytes.

    Pairs that differ in a few probed places go first. The others are put in order by their distance, so that pairs of
    neighbouring places share their bytes: every byte of such a run is compared once, and a pair agrees if no byte of its
    window differs.
    """
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(np.uint64).ravel()
    left = np.arange(len(a))
    for at in [0, length - 8, length // 2, length // 4, 3 * length // 4] if length >= 16 else []:
        left = left[eight[a[left] + at] == eight[b[left] + at]]
    same = np.zeros(len(a), bool)
    if not len(left):
        return same
    low, apart = np.minimum(a[left], b[left]), np.abs(a[left] - b[left])
    order = np.lexsort((low, apart))
    left, low, apart = left[order], low[order], apart[order]
    new = np.concatenate([[True], (apart[1:] != apart[:-1]) | (low[1:] > low[:-1] + length)])
    start = np.flatnonzero(new)
    last = np.append(start[1:] - 1, len(low) - 1)
    sizes = low[last] + length - low[start]
    begin = np.cumsum(sizes) - sizes
    run = np.cumsum(new) - 1
    for lo, hi in parts_of(sizes, 1 << 22):
        at = np.repeat(low[start[lo:hi]] - (begin[lo:hi] - begin[lo]), sizes[lo:hi]) + np.arange(int(sizes[lo:hi].sum()))
        differ = np.concatenate([[0], np.cumsum(s[at] != s[at + np.repeat(apart[start[lo:hi]], sizes[lo:hi])])])
        own = np.arange(start[lo], last[hi - 1] + 1)
        place = begin[run[own]] - begin[lo] + low[own] - low[start[run[own]]]
        same[left[own]] = differ[place + length] == differ[place]
    return same


def parts_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of runs of about `most` bytes each."""
    lo = 0
    upto = np.cumsum(sizes)
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def recurring_suffixes(length: int):
    def recurring(payload: list[bytes]) -> list[np.ndarray]:
        """Which strings of `length` bytes of a shard's contexts occur more than once in it."""
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(x, len(number)) for x in payload])
        texts = list(number)
        many = np.bincount(of) > 1
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(x) for x in texts])
        counts = sizes - length + 1
        begin = np.cumsum(sizes) - sizes
        ranks = suffix_ranks(raw.astype(np.int64) + 1, length)
        at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        order = order_of(ranks[at], width(ranks))
        same = equal_prefixes(raw, at[order[:-1]], at[order[1:]], length)
        flags = np.zeros(len(at), bool)
        flags[order[:-1][same]] = True
        flags[order[1:][same]] = True
        flags |= np.repeat(many, counts)
        each = np.split(flags, np.cumsum(counts)[:-1])
        return [each[i] for i in of]

    return recurring


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs, array of start, stop), kept (binary) of every row.

    Texts are UTF-8 bytes, a null text none. Every byte that a string of `length` bytes covers that also starts
    anywhere else is removed, in repeated rows as well; strings don't cross texts. Kept bytes may end inside a
    character, so they are binary. An empty table gives an empty result. A very long text is handled whole, in the
    memory of one task (some 60 bytes a byte of it). Other columns are ignored, whatever their names are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for names, texts in in_parts(batch):
                out = []
                for text, spans in zip(texts, batch.column(2).slice(lo, len(texts)).to_pylist(), strict=True):
                    raw = text.encode()
                    cut = merged(np.array([(x["start"], x["stop"]) for x in spans or []], np.int64).reshape(-1, 2)).tolist()
                    edges = [0, *(x for c in cut for x in c), len(raw)]
                    out.append((len(raw), sum(b - a for a, b in cut), [{"start": a, "stop": b} for a, b in cut], b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
                lo += len(texts)
                n, removed, spans, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPAN_TYPE), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    texts = keyed(docs, text_col, id_col)
    spans = recurring_spans(texts, length, gram, False, recurring_suffixes(length))
    joined = texts.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
