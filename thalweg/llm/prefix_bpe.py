"""BPE encoding by dynamic programming over prefixes, and decoding.

Among the tokens that end a prefix of a piece exactly one is the last token of that prefix's encoding: the one that is
compatible with the last token of what lies before it. Two tokens are compatible if their bytes, encoded together, fall
into just these two, which is seen by undoing their merges from the latest on: a merge over the border that would have
come before the merge undone last joins them. So a left-to-right pass keeps one last token a prefix, and the ids are
read off by going back from the end, in time linear in the piece.

Which tokens end a prefix is told by a suffix automaton of the vocabulary: its state after each byte stands for the
longest suffix read that occurs in any token, and the tokens among the shorter suffixes lie along its suffix links.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MOST_PIECES, in_parts
from .common import text_of

#: A worker forgets its pairs beyond this number, as it forgets its pieces beyond MOST_PIECES.
MOST_PAIRS = 1_000_000
NEVER = 1 << 40
BEYOND = re.compile("[^\0-\u0377]").search  # below, all characters are assigned


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class SuffixAutomaton:
    """Of many words: the states are the classes of substrings that end at the same places."""

    def __init__(self, words: dict[bytes, int]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size = array("i", [-1]), array("i", [0])
        ends = {self.add(word): value for word, value in words.items()}
        # the tokens that are suffixes of a state's longest string, longest first, as (token, size)
        self.found: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.go)
        self.found[0] = ()
        for state in sorted(range(1, len(self.go)), key=self.size.__getitem__):
            shorter = self.found[self.link[state]]
            self.found[state] = ((ends[state], self.size[state]), *shorter) if state in ends else shorter

    def add(self, word: bytes) -> int:
        """The state of the whole word, which always is the longest string of its class."""
        last = 0
        for byte in word:
            known = self.go[last].get(byte)
            if known is not None:
                last = known if self.size[known] == self.size[last] + 1 else self.split(last, byte, known)
                continue
            new = self.new({}, self.size[last] + 1)
            at = last
            while at >= 0 and byte not in self.go[at]:
                self.go[at][byte] = new
                at = self.link[at]
            if at < 0:
                self.link[new] = 0
            else:
                known = self.go[at][byte]
                self.link[new] = known if self.size[known] == self.size[at] + 1 else self.split(at, byte, known)
            last = new
        return last

    def new(self, go: dict[int, int], size: int) -> int:
        self.go.append(go)
        self.link.append(0)
        self.size.append(size)
        return len(self.go) - 1

    def split(self, at: int, byte: int, known: int) -> int:
        """A state of its own for the strings of `known` that are at most one byte longer than those of `at`."""
        twin = self.new(dict(self.go[known]), self.size[at] + 1)
        self.link[twin], self.link[known] = self.link[known], twin
        while at >= 0 and self.go[at].get(byte) == known:
            self.go[at][byte] = twin
            at = self.link[at]
        return twin


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, byte_of = held["model"], byte_letters()
        self.tokens = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}  # of a pair's merge
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> rank of its merge, left part, right part
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.rank[a, b] = rank
            assert whole not in self.made, "a token of two merges has no unique place in the order"
            self.made[whole] = (rank, a, b)
        single = {t[0]: i for i, t in self.tokens.items() if len(t) == 1}
        assert len(single) == 256 and held["normalizer"] is None and not held["pre_tokenizer"]["add_prefix_space"]
        self.automaton = SuffixAutomaton({self.tokens[i]: i for i in (*single.values(), *self.made)})
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.added.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.packed = {i: i.to_bytes(4, "little") for i in self.tokens}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and then of b are encoded as a, b."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > MOST_PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.stay_apart(a, b)
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        limit = NEVER
        while self.rank.get((a, b), NEVER) >= limit or (a, b) not in self.rank:
            own, other = self.made.get(a), self.made.get(b)
            if own is None and other is None:
                return True
            if other is None or own is not None and own[0] > other[0]:
                limit, a = own[0], own[2]  # an equal merge over the border would lie further right, so come later
            else:
                limit, b = other[0] + 1, other[1]  # here it would lie further left, so come first
        return False

    def encode_piece(self, piece: bytes) -> list[int]:
        go, link, longest, found, fits = self.automaton.go, self.automaton.link, self.automaton.size, self.automaton.found, self.fits
        last = [-1] * (len(piece) + 1)  # of each prefix
        state = held = 0  # held bytes of the piece are the longest suffix that any token contains
        for end, byte in enumerate(piece, 1):
            while byte not in go[state]:  # each byte is a token, so the first state knows it
                state = link[state]
                held = longest[state]
            state, held = go[state][byte], held + 1
            for token, size in found[state] if held == longest[state] else found[link[state]]:
                if size == end:
                    last[end] = token
                    break
                pair = last[end - size], token
                fit = fits.get(pair)
                if fit or fit is None and self.compatible(*pair):
                    last[end] = token
                    break
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def unassigned(text: str) -> bool:
    """Whether Python's Unicode tables miss any of the characters; on all others the libraries agree what is a letter, digit or space."""
    return BEYOND(text) is not None and any(unicodedata.category(c) == "Cn" for c in set(text))


class Encoder:
    """Encodes texts; remembers the ids of pieces, as 32-bit integers, for pieces repeat often."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.vocab, self.ids = vocabulary(path), {}
        self.find_pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.own_cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.find_added = re.compile("(" + "|".join(map(re.escape, self.vocab.added)) + ")").split if self.vocab.added else lambda t: [t]

    def pieces(self, text: str) -> list[str]:
        if unassigned(text):
            return [text[a:b] for _, (a, b) in self.own_cut(text)]
        return self.find_pieces(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if len(self.ids) > MOST_PIECES:
            self.ids.clear()
        out: list[bytes] = []
        for i, part in enumerate(self.find_added(text)):
            if i % 2:
                out.append(self.vocab.packed[self.vocab.added[part]])
                continue
            pieces = self.pieces(part)
            for piece in set(pieces).difference(self.ids):
                self.ids[piece] = array("I", self.vocab.encode_piece(piece.encode())).tobytes()
            out += map(self.ids.__getitem__, pieces)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocab.tokens.__getitem__, array("I", ids))).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) of every row. No shuffle.

    A null or empty text gives no ids. Repeated rows give the same ids each. Texts and pieces are encoded whole, however
    long. An added token spelt out in a text is that token. An empty table gives no row; other columns are ignored,
    whatever their names are.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for names, texts in in_parts(batch, 1 << 18):
                ids = [encoder.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays([names, pa.array([array("i", x).tolist() for x in ids], pa.list_(pa.int32())), pa.array(map(encoder.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256 of every row, without carrying the ids out."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for names, texts in in_parts(batch, 1 << 20):
                n, a, b = [], [], []
                for text in texts:
                    ids = encoder.encode(text)
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
