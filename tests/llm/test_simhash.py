"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from thalweg.llm import simhash
from thalweg.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, "a", "a b", "A b\tC", "a b c d", "Ünï Çode WORDS here\n\x0bx", "\x1c a b c", "w " * 900, " ".join(f"t{i % 301}" for i in range(2000))])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == brute_fingerprint(text)


def clusters(rng, n, far):
    fps = [rng.getrandbits(64) for _ in range(far)]
    while len(fps) < n:
        x = rng.choice(fps)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    return fps


@pytest.mark.parametrize("large", [4096, 8])
def test_components_equal_brute_force(spark, large, monkeypatch):
    monkeypatch.setattr(simhash.link_edges, "__defaults__", (2, large))
    fps = clusters(random.Random(large), 500, 60)
    rows = spark.createDataFrame([(i, i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, row_no long, fp long")
    got = {r.doc_id: r for r in simhash.near_duplicates(rows).collect()}
    right = brute_components(fps)
    assert [got[i].component_id for i in range(len(fps))] == right
    assert sorted(i for i, r in got.items() if r.keep) == sorted(set(right))


def test_one_dense_group(spark):
    fps = [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    rows = spark.createDataFrame([(i, i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, row_no long, fp long")
    assert {r.component_id for r in simhash.near_duplicates(rows).collect()} == {0}


def test_whole_texts(spark):
    texts = ["", None, "x", "x", "some words that repeat here " * 30, "some words that repeat here " * 29 + "some words that repeat HERE", "other " * 5] + [f"text number {i} of many" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = simhash.fingerprints(df)
    got = {r.doc_id: r for r in simhash.near_duplicates(rows).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == brute_components(fps)
    assert simhash.near_duplicates(simhash.fingerprints(df.limit(0))).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "zz yy xx ww")], SCHEMA)
    rows = simhash.near_duplicates(simhash.fingerprints(df)).collect()
    assert len(rows) == 4 and sum(r.keep for r in rows) == 2


def test_connected_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def test_hubs_are_joined_apart(spark, monkeypatch):
    from thalweg.llm import components

    monkeypatch.setattr(components, "FEW_EDGES", 0)
    edges = spark.createDataFrame([(0, i) for i in range(1, 900)] + [(i, i + 1) for i in range(2000, 2020)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(900), 0), **dict.fromkeys(range(2000, 2021), 2000)}
