"""Byte-level BPE encoding and decoding with padded numpy matrices.

The texts of a batch are cut into pieces by the vocabulary's pattern. Pieces that this worker has not seen yet are
encoded together: they are grouped by length into buckets, each bucket is a matrix of token ids with one row a piece,
and in every round each row looks all its neighbouring pairs up in a hash table, merges its leftmost pair of lowest
rank, and is compacted by one column. Rows without a pair that can merge leave the matrix. A piece of more than LONG
bytes is a bucket of its own whose row is linked instead of compacted: its pairs wait in a heap by rank and place, so
the leftmost pair of lowest rank is merged each time here too, in n log n instead of n * n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

NONE = np.int64(1 << 40)
#: A worker forgets its pieces beyond this number, so its memory does not grow with the input.
MOST_PIECES = 400_000
LONG = 1024


class PairTable:
    """Open addressing: (left id, right id) -> id of the merged token, which is its rank as well."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (3 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        for (a, b), v in pairs.items():
            key = (a << 32) | b
            at = self.slot_of(key)
            while self.keys[at] != -1:
                at = (at + 1) & (size - 1)
            self.keys[at], self.values[at] = key, v

    def slot_of(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where a pair has none or an id is negative (padding)."""
        keys = (left << 32) | right
        out = np.full(keys.shape, NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys, flat = keys.ravel(), out.ravel()
        at = ((keys[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        while todo.size:
            held = self.keys[at]
            hit = held == keys[todo]
            flat[todo[hit]] = self.values[at[hit]]
            go = ~hit & (held != -1)
            todo, at = todo[go], (at[go] + 1) & (self.keys.size - 1)
        return flat.reshape(out.shape)


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.find_pieces = regex.compile(pattern).findall
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs, self.rank_of = PairTable(pairs), pairs

    def encode_pieces(self, pieces: list[bytes], cells: int = 1 << 20) -> list[list[int]]:
        """Ids of each piece; a piece that is a token is that token, as tiktoken has it."""
        out: list[list[int] | None] = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if piece in self.ranks:
                out[i] = [self.ranks[piece]]
            elif len(piece) > LONG:
                out[i] = self.merge_linked(piece)
            else:
                by_length.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in by_length.items():
            for lo in range(0, len(members), step := max(1, cells // width)):
                part = members[lo : lo + step]
                lengths = np.array([len(pieces[i]) for i in part])
                grid = np.full((len(part), width), -1, np.int64)
                grid[np.arange(width) < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                for i, ids in zip(part, self.merge(grid, lengths), strict=True):
                    out[i] = ids
        return out

    def merge_linked(self, piece: bytes) -> list[int]:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self.pairs.find(ids[:-1], ids[1:])
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        ids.append(-1)
        heap = [(int(first[i]), i) for i in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        rank_of = self.rank_of
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank_of.get((ids[i], ids[j])) != rank:
                continue  # one of the two has been merged since
            k = after[j]
            ids[i], ids[j], after[i] = rank, -1, k
            if k < n:
                before[k] = i
                if (x := rank_of.get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := rank_of.get((ids[h], rank))) is not None:
                heapq.heappush(heap, (x, h))
        return [x for x in ids if x >= 0]

    def merge(self, grid: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """Rounds of merges; grid holds ids from the left, then -1."""
        done: list[list[int]] = [[]] * len(grid)
        rows, lengths = np.arange(len(grid)), lengths.copy()
        ranks = self.pairs.find(grid[:, :-1], grid[:, 1:])
        while len(rows):
            best = ranks.argmin(axis=1)
            at = np.arange(len(rows))
            rank = ranks[at, best]
            over = rank == NONE
            if over.any():
                for i in np.flatnonzero(over):
                    done[rows[i]] = grid[i, : lengths[i]].tolist()
                go = ~over
                rows, lengths, grid, ranks, best, rank = rows[go], lengths[go], grid[go], ranks[go], best[go], rank[go]
                if not len(rows):
                    break
                width = max(2, int(lengths.max()))
                grid, ranks = grid[:, :width], ranks[:, : width - 1]
                at = np.arange(len(rows))
            # compaction: columns behind the merged pair move one to the left
            width = grid.shape[1]
            source = np.arange(width) + (np.arange(width) > best[:, None])
            grid = np.where(source < width, np.take_along_axis(grid, np.minimum(source, width - 1), axis=1), -1)
            grid[at, best] = rank
            lengths -= 1
            source = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
            ranks = np.where(source < width - 1, np.take_along_axis(ranks, np.minimum(source, width - 2), axis=1), NONE)
            after = np.minimum(best + 1, width - 1)
            ranks[at, np.minimum(best, width - 2)] = np.where(best < width - 1, self.pairs.find(grid[at, best], np.where(best < width - 1, grid[at, after], -1)), NONE)
            before = np.maximum(best - 1, 0)
            left = self.pairs.find(np.where(best > 0, grid[at, before], -1), grid[at, best])
            ranks[at, before] = np.where(best > 0, left, ranks[at, before])
        return done


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


class Encoder:
    """Encodes texts; remembers pieces with their ids, for pieces repeat often."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.ids = vocab, {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        if len(self.ids) > MOST_PIECES:
            self.ids.clear()
        cut = [self.vocab.find_pieces(t) for t in texts]
        new = [p for p in set().union(*cut) if p not in self.ids]
        self.ids.update(zip(new, map(tuple, self.vocab.encode_pieces([p.encode() for p in new])), strict=True))
        for pieces in cut:
            yield list(chain.from_iterable(map(self.ids.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, ids))


def in_parts(batch: pa.RecordBatch, size: int = 1 << 21) -> Iterator[tuple[pa.Array, list[str]]]:
    """The identifiers and texts of a batch, about `size` bytes at a time; no more texts than that are Python strings at once."""
    sizes = pc.binary_length(batch.column(1)).to_pylist()
    lo = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total > size or i + 1 == len(sizes):
            yield batch.column(0).slice(lo, i + 1 - lo), batch.column(1).slice(lo, i + 1 - lo).to_pylist()
            lo, total = i + 1, 0


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) of every row; a null or empty text gives no ids. No shuffle.

    Repeated rows give the same ids each. Texts and pieces are encoded whole, however long. An empty table gives no row;
    other columns are ignored, whatever their names are.
    """
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path, pattern))
        for batch in batches:
            for names, texts in in_parts(batch, 1 << 18):
                ids = list(encoder.encode(texts))
                yield pa.RecordBatch.from_arrays([names, pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(i) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 of every row, without carrying the ids out."""
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path, pattern))
        name = {i: str(i) for i in encoder.vocab.tokens}
        for batch in batches:
            for names, texts in in_parts(batch):
                out = [(len(ids), hashlib.sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()) for ids in encoder.encode(texts)]
                n, a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
