"""Substring deduplication with repeated-phrase automata.

Anchors (see repeats.py) route every stretch of every document that may hold a recurring passage to the shard of its
anchor. In a shard, windows of 35 words of equal hash give the candidates, and those that always follow one another are
put together into passages. A shard's passages are compiled into one Aho-Corasick automaton over word numbers, and all
stretches routed to the shard are streamed through it. It locates every occurrence by the words themselves: a passage is
confirmed if it is found twice, and only words of located, confirmed passages are removed. Windows that a hash put
under another window's words are not found by its passage and become passages of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import in_parts
from .repeats import keyed, merged, mix, prefix_sums, range_hashes, recurring_spans


def window_hashes(numbers: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return range_hashes(prefix_sums(mix(numbers.astype(np.uint64) + np.uint64(1))), at, at + length)


def chains(ids: np.ndarray, on: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of flagged windows that follow one another wherever they occur.

    ids names equal windows alike, on flags those that recur, new says which windows begin a stretch.
    """
    n = int(ids.max(initial=-1)) + 1
    after, before = np.full(len(ids), -1), np.full(len(ids), -1)
    follows = np.flatnonzero(on[1:] & on[:-1] & ~new[1:]) + 1
    after[follows - 1], before[follows] = ids[follows], ids[follows - 1]
    one = []
    for x in (after, before):
        least, most = np.full(n, n), np.full(n, -1)
        np.minimum.at(least, ids, x)
        np.maximum.at(most, ids, x)
        one.append(np.where(least == most, most, -1))
    linked = np.zeros(len(ids), bool)
    linked[follows] = (one[0][ids[follows - 1]] == ids[follows]) & (one[1][ids[follows]] == ids[follows - 1])
    own = np.flatnonzero(on)
    begin = np.flatnonzero(on & ~linked)
    last = own[np.append(np.searchsorted(own, begin)[1:] - 1, len(own) - 1)] if len(begin) else begin
    _, at = np.unique(ids[begin], return_index=True)
    return begin[at], last[at]


def recurring_passages(length: int):
    def recurring(payload: list[bytes]) -> list[np.ndarray]:
        """Which windows of `length` words of a shard's stretches occur more than once in it."""
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(x, len(number)) for x in payload])
        times = np.bincount(of)
        names: dict[bytes, int] = {}
        coded = [tuple([names.setdefault(w, len(names)) for w in text.split(b" ")]) for text in number]
        sizes = np.array([len(c) for c in coded])
        counts, begin = sizes - length + 1, np.cumsum(sizes) - sizes
        first = np.cumsum(counts) - counts
        flat = np.concatenate([np.array(c, np.int64) for c in coded])
        at = np.repeat(begin - first, counts) + np.arange(int(counts.sum()))
        _, ids = np.unique(window_hashes(flat, at, length), return_inverse=True)
        on = np.bincount(ids, np.repeat(times, counts))[ids] > 1
        new = np.zeros(len(ids), bool)
        new[first] = True
        lo, hi = chains(ids, on, new)
        passages = dict.fromkeys(tuple(flat[at[a] : at[b] + length].tolist()) for a, b in zip(lo.tolist(), hi.tolist(), strict=True))
        while passages:
            found = locate(list(passages), coded, times)
            flags = np.zeros(len(ids), bool)
            seen = np.zeros(len(ids), bool)
            for i, hits in enumerate(found):
                for start, stop, sure in hits:
                    seen[first[i] + start : first[i] + stop - length + 1] = True
                    if sure:
                        flags[first[i] + start : first[i] + stop - length + 1] = True
            missed = np.flatnonzero(on & ~seen)
            if not len(missed):
                break
            passages |= dict.fromkeys(tuple(flat[at[i] : at[i] + length].tolist()) for i in missed.tolist())
        each = np.split(flags if passages else on, np.cumsum(counts)[:-1])
        return [each[i] for i in of]

    return recurring


def locate(passages: list[tuple[int, ...]], texts: list[tuple[int, ...]], times: np.ndarray) -> list[list[tuple[int, int, bool]]]:
    """start, stop, confirmed of every occurrence of any passage in each text; texts[i] stands for times[i] equal ones."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for i, words in enumerate(passages):
        automaton.add_word(words, (len(words), i))
    automaton.make_automaton()
    hits = [[(end + 1 - n, end + 1, i) for end, (n, i) in automaton.iter(words)] for words in texts]
    count = np.zeros(len(passages), np.int64)
    for own, n in zip(hits, times.tolist(), strict=True):
        for *_, i in own:
            count[i] += n
    return [[(a, b, bool(count[i] > 1)) for a, b, i in own] for own in hits]


def remove_repeats(docs: DataFrame, length: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed runs of words, array of start, stop), kept (text) of every row.

    Words are what ASCII white space separates. Every word that lies in a window of `length` words that also starts
    anywhere else is removed, in repeated rows as well; windows don't cross texts. The kept words are joined by one
    space. A null, empty or short text keeps all its words. An empty table gives an empty result. A very long text is
    handled whole, in the memory of one task. Other columns are ignored, whatever their names are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for names, texts in in_parts(batch):
                out = []
                for text, held in zip(texts, batch.column(2).slice(lo, len(texts)).to_pylist(), strict=True):
                    words = text.encode().split()
                    spans = merged(np.array([(x["start"], x["stop"]) for x in held or []], np.int64).reshape(-1, 2)).tolist()
                    edges = [0, *(x for s in spans for x in s), len(words)]
                    kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]] if spans else words
                    out.append((len(words), sum(b - a for a, b in spans), [{"start": a, "stop": b} for a, b in spans], b" ".join(kept).decode()))
                lo += len(texts)
                yield pa.RecordBatch.from_arrays([names, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), SPAN, pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    texts = keyed(docs, text_col, id_col)
    spans = recurring_spans(texts, length, gram, True, recurring_passages(length))
    joined = texts.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string")


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
