"""What the pipeline's near copies take from SimHash fingerprints, and the stars that edges of a task become."""

import random

import numpy as np

from thalweg.llm import near
from thalweg.llm.components import forest


def test_fingerprints_alone_find_the_nearest_copies(spark, monkeypatch):
    """Without MinHash keys the blocks of fingerprints still propose: equal sets, and sets of fingerprints two bits apart."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base), " ".join(base).upper()]
    fp = near.majority(near.shingles(texts[0]))
    for k in range(20):
        text = " ".join([*base, f"end{k}"])
        if (near.majority(near.shingles(text)) ^ fp).bit_count() <= near.BITS:
            texts.append(text)
    assert len(texts) > 5 and len({near.majority(near.shingles(t)) for t in texts}) > 1
    texts += ["", None, " ".join(f"v{i}" for i in range(50))]
    monkeypatch.setattr(near, "band_keys", lambda hashes: [])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = len(texts)
    assert sorted(r.doc_id for r in near.drop_near_copies(docs).collect()) == [0, n - 3, n - 2, n - 1]


def test_equal_fingerprints_of_other_texts_stay(spark, monkeypatch):
    monkeypatch.setattr(near, "band_keys", lambda hashes: [])
    monkeypatch.setattr(near, "majority", lambda hashes: 5)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}-{j}" for j in range(30))) for i in range(12)], "doc_id long, text string")
    assert near.drop_near_copies(docs).count() == 12


def test_forest_equals_plain_union():
    rng = random.Random(5)
    for n in (1, 5, 40, 400):
        edges = [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(n)]
        least = {x: x for e in edges for x in e}
        for _ in least:
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        hi, lo = forest(*(np.array(x, np.int64) for x in zip(*edges, strict=True)))
        assert dict(zip(hi.tolist(), lo.tolist(), strict=True)) == {k: v for k, v in least.items() if k != v}
