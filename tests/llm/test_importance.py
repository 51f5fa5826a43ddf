"""Importance resampling against plain n-gram strings and their CRCs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from thalweg.llm import importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER)) if x]
    return [" ".join(w[i : i + k]).encode() for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target, least_words=20, per_cent=5):
    buckets = lambda t: [zlib.crc32(f) % 10000 for f in features(t)[0]]
    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_t * 0 + n_s + 10000.0) / ((s[b] + 1.0) * (n_t + 10000.0))))
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets(x)))
        rows.append([i, features(x)[1], len(buckets(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: per_cent * len(able) // 100])}
    return sorted(([*r, ranks.get(id(r))] for r in rows), key=repr)


def test_scores_equal_brute_force(spark):
    rng = random.Random(11)
    words = ["Straße", "the", "THE", "a", "日本語", "x" * 255, "y" * 256, "z" * 70_000, "it's", "word_2", "é\x00f", "end", "12"]
    docs = [(i, " ".join(rng.choices(words, [1, 9, 2, 9, 2, 0.2, 0.2, 0.02, 3, 3, 2, 5, 4], k=rng.randint(0, 90)))) for i in range(300)]
    docs += [(None, "the end of it " * 20), (5, docs[5][1]), (5, "the a " * 30), (400, None), (401, ""), (402, "-- .. \n"), (403, "one"), (404, "one two"), (405, "the\tend " * 30_000)]
    target = ["the end", None, "", "a 12 " * 30, docs[3][1]]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS rank", "1 AS score", "2 AS key", "3 AS row_no").repartition(3)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((list(r) for r in importance.scores(df, other).collect()), key=repr)
    assert got == brute(docs, target)
    drawn = {r[0] for r in got if r[5] is not None}
    kept = importance.resample(df, other)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == drawn


def test_ties_go_to_smaller_identifiers(spark, monkeypatch):
    monkeypatch.setattr(importance, "noise", lambda c, seed: importance.F.lit(0).cast("long"))
    docs = spark.createDataFrame([(i, "same words here " * 10) for i in range(40, 0, -1)], "doc_id long, text string").repartition(5)
    got = importance.scores(docs, docs, per_cent=10).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [(r.doc_id, r["rank"]) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.scores(none, none).count() == 0
    assert [list(r)[:3] for r in importance.scores(one, none).collect()] == [[1, 3, 6]]


def test_shift_is_that_of_the_crc():
    import numpy as np

    for n in (0, 1, 7, 255, 256, 257, 4096, 70_001):
        assert importance.shifted(np.array([zlib.crc32(b"left")], np.uint32), np.array([n]))[0] ^ zlib.crc32(b"\x07" * n) == zlib.crc32(b"left" + b"\x07" * n)
