"""Substring deduplication by suffixes and by phrase automata against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from thalweg.llm import phrases, repeats, suffixes

SCHEMA = "doc_id long, text string, spans string, k1 string, k2 string, g string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", "x", "x", None) for i, t in enumerate(texts)], SCHEMA).repartition(5)


def brute(symbols, length):
    """Removed positions of each list of symbols."""
    seen = Counter(tuple(s[i : i + length]) for s in symbols for i in range(len(s) - length + 1))
    return [sorted({j for i in range(len(s) - length + 1) if seen[tuple(s[i : i + length])] > 1 for j in range(i, i + length)}) for s in symbols]


def corpus(rng):
    words = [rng.choice(["the", "of", "naïve", "x", "lorem", "漢字", "and", "zz9"]) + str(rng.randrange(400)) for _ in range(3000)]
    passages = [" ".join(words[i * 60 : i * 60 + rng.randint(5, 60)]) for i in range(12)]
    out = ["", None, " ", "one", "a" * 700, "a" * 300, passages[0], "same text " * 100, "same text " * 100]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{i}{rng.randrange(10**6)}" for _ in range(rng.randint(1, 50))))
        out.append(rng.choice([" ", "\n", "\t "]).join(parts))
    return out


def check_words(texts, rows, length):
    got = {r.doc_id: r for r in rows}
    words = [(t or "").encode().split() for t in texts]
    assert len(got) == len(texts)
    for i, gone in enumerate(brute(words, length)):
        keep = [w for j, w in enumerate(words[i]) if j not in set(gone)]
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(words[i]), len(gone), b" ".join(keep).decode())


def check_bytes(texts, rows, length):
    got = {r.doc_id: r for r in rows}
    raw = [(t or "").encode() for t in texts]
    assert len(got) == len(texts)
    for i, gone in enumerate(brute(raw, length)):
        assert (got[i].n_bytes, got[i].n_removed) == (len(raw[i]), len(gone))
        assert bytes(got[i].kept) == bytes(b for j, b in enumerate(raw[i]) if j not in set(gone))
        assert len(got[i].spans) == sum(j == 0 or gone[j - 1] != x - 1 for j, x in enumerate(gone))


#: hot anchors from so many stretches on, bytes of a shard, most keys for which the bitmap is used, its bits
WAYS = [(256, 1 << 20, 1 << 26, 28), (3, 1500, 1 << 26, 28), (1, 1, 1 << 26, 10), (2, 4000, 0, 28)]


@pytest.fixture(params=WAYS)
def way(request, monkeypatch):
    for name, value in zip(("LEAST_HOT", "SHARD_BYTES", "MOST_KEYS", "MOST_BITS"), request.param, strict=True):
        monkeypatch.setattr(repeats, name, value)
    if request.param[0] < 256:
        monkeypatch.setattr(repeats, "SHARES", 500)


@pytest.mark.parametrize("length", [35, 9])
def test_phrases_equal_brute_force(spark, way, length):
    texts = corpus(random.Random(length))
    check_words(texts, phrases.remove_repeats(table(spark, texts), length=length, gram=4).collect(), length)


@pytest.mark.parametrize("length", [400, 61])
def test_suffixes_equal_brute_force(spark, way, length):
    texts = corpus(random.Random(length))
    check_bytes(texts, suffixes.remove_repeats(table(spark, texts), length=length, gram=16).collect(), length)


def test_occurrences_in_other_shards_of_an_anchor(spark, monkeypatch):
    """One passage in many texts, and one in two: with a shard for each stretch nothing recurs in its own shard."""
    monkeypatch.setattr(repeats, "LEAST_HOT", 1)
    monkeypatch.setattr(repeats, "SHARES", 10**6)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1)
    shared, pair = " ".join(f"s{i}" for i in range(80)), " ".join(f"p{i}" for i in range(40))
    texts = [" ".join([f"a{i}", shared, *(f"{i}b{j}" for j in range(9)), pair if i < 2 else ""]) for i in range(40)]
    kinds = []
    held = phrases.recurring_passages(35)

    def seen(payload):
        flags = held(payload)
        kinds.append((len(payload), any(f.any() for f in flags)))
        return flags

    direct = seen([" ".join(t.split()[:60]).encode() for t in texts[:1]])
    assert not direct[0].any()
    check_words(texts, phrases.remove_repeats(table(spark, texts), gram=8).collect(), 35)
    check_bytes(texts, suffixes.remove_repeats(table(spark, texts)).collect(), 400)


def test_passages_are_confirmed_by_words(monkeypatch):
    """Windows under one hash that differ in their words: only those that are there twice recur."""
    monkeypatch.setattr(phrases, "window_hashes", lambda numbers, at, length: np.zeros(len(at), np.uint64))
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)).encode() for k in "abc")
    flags = phrases.recurring_passages(35)([a, b + b" end", b, c])
    assert [f.tolist() for f in flags] == [[False] * 6, [True] * 6 + [False], [True] * 6, [False] * 6]


@pytest.mark.parametrize("values", [2, 3, 256])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 50, 301, 902])
def test_difference_cover_order(n, values):
    rng = np.random.default_rng(n)
    s = rng.integers(0, values, n)
    if n > 60:
        s[n // 2 : n // 2 + n // 3] = s[: n // 3]
    got = np.argsort(suffixes.suffix_ranks(s + 1, n + 1), kind="stable").tolist()
    assert got == sorted(range(n), key=lambda i: s[i:].tolist())


def test_repeated_rows_long_texts_and_empty_tables(spark):
    text = " ".join(map(str, range(300)))
    df = table(spark, [text]).unionByName(table(spark, [text]))
    assert sorted(r.n_removed for r in phrases.remove_repeats(df).collect()) == [300, 300]
    assert sorted(r.n_removed for r in suffixes.remove_repeats(df).collect()) == [len(text), len(text)]
    assert phrases.remove_repeats(df.limit(0)).count() == suffixes.remove_repeats(df.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(400_000))
    texts = [long, f"x {long[1_000_000:1_001_000]} y"]
    got = {r.doc_id: r for r in suffixes.remove_repeats(table(spark, texts)).collect()}
    assert [got[i].n_removed for i in (0, 1)] == [1000, 1000] or [got[i].n_removed for i in (0, 1)] == [1001, 1001] or [got[i].n_removed for i in (0, 1)] == [1002, 1002]
    got = {r.doc_id: r for r in phrases.remove_repeats(table(spark, texts)).collect()}
    assert got[0].n_words == 400_000 and got[0].n_removed == got[1].n_removed > 100
