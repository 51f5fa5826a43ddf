"""Packing along a space-filling curve.

Each document becomes a hashed bag-of-tokens vector, which fixed random signs project to a few dimensions; its place
on a Hilbert curve through those dimensions is its key. A range sort of the keys, a prefix sum of the token counts of
its partitions, and a running sum within each give every document its first position in one long stream of tokens,
in which neighbours on the curve lie side by side. Sequence s is the positions from s * 4096 to (s + 1) * 4096, so
documents are cut at those borders and only the last sequence of all may need padding.

Token ids are computed once and written to the shared folder. What is sorted is a small row a document.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import in_parts
from .common import materialize, partitions, text_of

BUCKETS, DIMS, BITS = 1024, 4, 8
MOST_WORDS, TABLE_BITS = 1_200_000, 22  # words that a worker remembers; beyond them it starts anew
AT_ONCE = 500_000  # words of a text that are looked up together
BASE = 0x9E3779B97F4A7C15
#: Letters that Unicode normalisation leaves alone and that have one lower-case form.
PLAIN = re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.isin(np.arange(256), [9, 10, 13, 32])


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (one a row, each coordinate below 2**bits)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            low = q - 1
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents, from their token ids one after the other and how many each has."""
    n = len(counts)
    bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
    bags = np.bincount(np.repeat(np.arange(n), counts) * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    bags = np.log1p(bags.astype(np.float32))
    bags /= np.maximum(np.sqrt((bags * bags).sum(axis=1, keepdims=True)), 1e-9)
    signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (BUCKETS, DIMS))
    at = np.clip((bags @ signs + 3) / 6, 0, 1 - 1e-6)
    return hilbert_key((at * (1 << BITS)).astype(np.int64), BITS)


class WordEncoder:
    """Ids of whole texts. The tokenizer lower-cases, drops white space and never looks across it, so each word is
    encoded once, without a full stop or comma behind its last letter, and found again by the hash of its bytes; then
    the bytes are compared, and a word that another one's hash led astray is encoded by itself.

    New words of plain letters go to the tokenizer together, in one text: each is one token sequence that ends with the
    only token that ends a word, so the ids fall apart again at those. Other new words are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = {ord(m): self.one(m) for m in ".,"}
        assert all(len(x) == 1 for x in self.marks.values())
        self.values = np.random.default_rng(49).integers(1, 2**63, 256, dtype=np.uint64)
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int64)
        self.first, self.size = np.zeros(MOST_WORDS + 1, np.int64), np.zeros(MOST_WORDS + 1, np.int64)
        self.known, self.pool, self.used = 1, np.zeros(1 << 20, "<u2"), 0  # word 0 is the empty word
        self.letters, self.letters_used = np.zeros(1 << 20, np.uint8), 0
        self.letter_at, self.letter_n = np.zeros(MOST_WORDS + 1, np.int64), np.zeros(MOST_WORDS + 1, np.int64)

    def one(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the empty slot where it would be."""
        out = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[out[todo]]
            todo = todo[(held != keys[todo]) & (held != 0)]
            out[todo] = (out[todo] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids: list[np.ndarray | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w)]
        for lo in range(0, len(plain), 5000):
            part = plain[lo : lo + 5000]
            found = np.array(self.tokenizer.encode(" ".join([words[i] for i in part]), add_special_tokens=False).ids, "<u2")
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) == len(part):
                for i, x in zip(part, np.split(found, cuts[:-1]), strict=True):
                    ids[i] = x
        ids = [self.one(w) if x is None else x for w, x in zip(words, ids, strict=True)]
        sizes = np.array([len(x) for x in ids])
        flat = np.concatenate(ids)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), "<u2")])
        new = np.arange(self.known, self.known + len(words))
        spelt = [w.encode() for w in words]
        lengths = np.array([len(x) for x in spelt])
        while self.letters_used + int(lengths.sum()) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros(len(self.letters), np.uint8)])
        self.letters[self.letters_used : self.letters_used + int(lengths.sum())] = np.frombuffer(b"".join(spelt), np.uint8)
        self.letter_at[new], self.letter_n[new] = self.letters_used + np.cumsum(lengths) - lengths, lengths
        self.letters_used += int(lengths.sum())
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.known = self.used + len(flat), self.known + len(words)
        while len(keys):
            at = self.slots(keys)
            self.keys[at], self.at[at] = keys, new  # of several keys for one empty slot the last one stays
            out = self.keys[at] != keys
            keys, new = keys[out], new[out]

    def hashes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of raw[start:end] for every pair, from one prefix sum; never 0."""
        n = len(raw)
        while len(self.powers) < n + 1:
            self.powers, self.inverses = (np.concatenate([x, x * np.uint64(pow(base, len(x), 1 << 64))]) for x, base in ((self.powers, BASE), (self.inverses, pow(BASE, -1, 1 << 64))))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.values[raw] * self.powers[:n])])
        keys = (sums[end] - sums[start]) * self.inverses[start]
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.where(keys == 0, np.uint64(1), keys)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        coded = [t.encode() for t in texts]
        raw = LOWER[np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)]
        gap = GAP[raw]
        start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        last, before = raw[end - 1], raw[np.maximum(end - 2, 0)]
        letter = (before >= 97) & (before <= 122) | (before >= 0x80) & (raw[np.maximum(end - 3, 0)] == 0xC3) & (before != 0x97) & (before != 0xB7)
        marked = (end - start > 1) & letter & ((last == 46) | (last == 44))
        stem = end - marked
        parts = [self.ids_of(raw, start[lo : lo + AT_ONCE], stem[lo : lo + AT_ONCE], marked[lo : lo + AT_ONCE], last[lo : lo + AT_ONCE]) for lo in range(0, len(start), AT_ONCE)]
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, "<u2")
        total = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        borders = np.cumsum([1] + [len(c) + 1 for c in coded])
        upto = np.concatenate([[0], np.cumsum(total)])[np.searchsorted(start, borders)]
        return ids, np.diff(upto)

    def ids_of(self, raw: np.ndarray, start: np.ndarray, stem: np.ndarray, marked: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words raw[start:stem], each with its mark, one after the other, and how many each has."""
        keys, index, inverse = np.unique(self.hashes(raw, start, stem), return_index=True, return_inverse=True)
        if self.known + len(keys) > MOST_WORDS:
            self.clear()
        new = np.flatnonzero(self.keys[self.slots(keys)] != keys)
        if len(new):
            whole = raw.tobytes()
            for lo in range(0, len(new), 20_000):
                part = new[lo : lo + 20_000]
                self.learn(keys[part], [whole[a:b].decode() for a, b in zip(start[index[part]].tolist(), stem[index[part]].tolist(), strict=True)])
        word = self.at[self.slots(keys)][inverse]
        for i in self.strangers(raw, start, stem, word).tolist():
            if self.known >= len(self.first):
                self.grow()
            self.learn(np.zeros(0, np.uint64), [raw[start[i] : stem[i]].tobytes().decode()])
            word[i] = self.known - 1
        size = self.size[word]
        total = size + marked
        at = np.cumsum(total) - total
        source = np.repeat(self.first[word] - at, total) + np.arange(int(total.sum()))
        place = at[marked] + size[marked]
        source[place] = 0
        ids = self.pool[source]
        ids[place] = np.where(last[marked] == 46, self.marks[46][0], self.marks[44][0])
        return ids, total

    def strangers(self, raw: np.ndarray, start: np.ndarray, stem: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which words differ in their bytes from those that they were found as."""
        size = stem - start
        odd = self.letter_n[word] != size
        size = np.where(odd, 0, size)
        shift = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        differ = raw[np.repeat(start - shift, size) + step] != self.letters[np.repeat(self.letter_at[word] - shift, size) + step]
        if differ.any():
            odd[np.searchsorted(shift, np.flatnonzero(differ), "right") - 1] = True
        return np.flatnonzero(odd)

    def grow(self) -> None:
        """Room for more words than are remembered, until the next start."""
        self.first, self.size, self.letter_at, self.letter_n = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.first, self.size, self.letter_at, self.letter_n))


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def split_bytes(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array with the bytes of the ids of each document."""
    offsets = np.concatenate([[0], 2 * np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])


def tokenize(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """row_no, doc_id, ids (16-bit, with end_id last), n_ids and curve key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            lo = 0
            for names, texts in in_parts(batch, 1 << 20):
                ids, counts = encoder.encode(texts)
                ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype("<u2"), counts + 1
                keys = document_keys(ids, counts)
                rows = batch.column(2).slice(lo, len(texts))
                lo += len(texts)
                yield pa.RecordBatch.from_arrays([rows, names, split_bytes(ids, counts), pa.array(counts, pa.int64()), pa.array(keys, pa.int64())], ["row_no", "doc_id", "ids", "n_ids", "key"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row_no"))
    return rows.mapInArrow(run, "row_no long, doc_id long, ids binary, n_ids long, key long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 2, path: str | None = None) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, ids (array).

    A null or empty text is the end id alone. Equal keys are ordered by row number, so ties and repeated rows have a
    place each. An empty table gives no piece. All sequences but the last of all are full. Texts are encoded whole,
    however long and of however many different words. Other columns are ignored, whatever their names are.
    """
    tokens = materialize(tokenize(docs, id_col, text_col, path or public_tokenizers.path("word_bpe_49k.json"), end_id), "tokens")
    # A row number breaks ties of the range sort too, so a key that many documents share is spread over partitions.
    sorted_rows = tokens.select("row_no", "n_ids", "key").repartitionByRange(partitions(docs.sparkSession), "key", "row_no")
    own = Window.partitionBy("part").orderBy("key", "row_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(sorted_rows.withColumn("part", F.spark_partition_id()), "curve")
    sums = placed.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each partition
    base, bases = 0, []
    for part, n in sums:
        bases.append((part, base))
        base += n
    before = docs.sparkSession.createDataFrame(bases, "part int, base long")
    at = placed.withColumn("before", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(F.broadcast(before), "part").select("row_no", (F.col("base") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, ids, n, pos in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(ids, "<u2")
                start = 0
                while start < n:
                    offset = (pos + start) % length
                    size = min(n - start, length - offset)
                    out.append((doc_id, start, size, n, (pos + start) // length, offset, ids[start : start + size].astype("<u4")))
                    start += size
            if out:
                columns = list(zip(*out, strict=True))
                flat = pa.array(np.concatenate(columns[6]).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(columns[2])]), pa.int32()), flat)
                crc = pa.array([zlib.crc32(x.tobytes()) for x in columns[6]], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:6]), crc, lists], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"])

    whole = tokens.select("row_no", "doc_id", "ids", "n_ids").join(at, "row_no").select("doc_id", "ids", "n_ids", "at")
    return whole.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids array<int>")
