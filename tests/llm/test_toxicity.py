"""The toxicity classifier: held-out recall, neutral mentions of groups, and awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import toxicity

NEUTRAL = "meet visit garden table summer letter window music paper river bread light story travel family school market kitchen winter morning".split()
HARSH = "vile slime wretch filth scum".split()


def texts(rng, n, harsh, mention):
    out = []
    for _ in range(n):
        own = [rng.choice(NEUTRAL) for _ in range(12)]
        if harsh:
            own += rng.sample(HARSH, 2)
        if rng.random() < mention:
            own.append("muslims")
        rng.shuffle(own)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_held_out_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter(toxicity.held_out("doc_id"))
    hit = F.col("score") >= 0.5
    n, caught, false, clean = scored.agg(F.sum("toxic"), F.sum(F.when(hit, F.col("toxic"))), F.sum(F.when(hit, 1 - F.col("toxic"))), F.sum(1 - F.col("toxic"))).first()
    assert caught >= (0.9 if n > 20 else 0.6) * n and false <= 0.02 * clean, (n, caught, false, clean)


def test_counterfactuals_reduce_false_positives_on_neutral_mentions(spark):
    """Attacks in the sample mostly name one group, so the mention alone looks like one to a model without the penalty."""
    rng = random.Random(4)
    rows = [(i, t, 1) for i, t in enumerate(texts(rng, 300, False, 0.95)[:150] + texts(rng, 150, True, 0.9))]
    rows += [(1000 + i, t, 0) for i, t in enumerate(texts(rng, 300, False, 0.02))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    tests = spark.createDataFrame(list(enumerate(texts(rng, 200, False, 1.0) + texts(rng, 200, True, 1.0))), "doc_id long, text string")
    false, caught = {}, {}
    for strength in (0.0, toxicity.STRENGTH):
        options = {} if strength else {"counterfactual": 0.0}  # the default strength, which the query and the pipeline use
        got = {r.doc_id: r.score for r in toxicity.score(tests, toxicity.train(docs, labels, **options)).collect()}
        false[strength], caught[strength] = (sum(got[i] >= 0.5 for i in part) for part in (range(200), range(200, 400)))
    assert false[0.0] >= 100 and false[toxicity.STRENGTH] < false[0.0] / 2, (false, caught)
    assert caught[toxicity.STRENGTH] >= 0.9 * 200, (false, caught)


def test_awkward_rows(spark):
    schema = "doc_id long, text string, score string, features string, _text string"
    rows = [(i, "kind words here" if i % 2 else "vile slime here", "x", "x", "x") for i in range(200)]
    rows += [(1, "kind words here", "x", "x", "x")] * 500 + [(900, None, None, None, None), (901, "", "", "", ""), (None, "vile slime", "x", "x", "x"), (902, "vile slime " * 200_000, "x", "x", "x")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(200)] + [(1, 0)] * 300 + [(None, 1), (5, None), (7, 3)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] and by[902] > 0.5 > by[1] and by[None] > 0.5
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert toxicity.reject(docs, model).columns == docs.columns
    assert toxicity.train(docs, labels.limit(0)).bias == 0 and toxicity.score(docs.limit(0), model).count() == 0


def test_the_sample_is_bounded_however_rows_repeat(spark, monkeypatch):
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda features, *a, **k: seen.append(len(features)) or fit(features, *a, **k))
    docs = spark.createDataFrame([(i % 10, f"word{i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 10, i % 2) for i in range(2000)], "doc_id long, toxic int")
    toxicity.train(docs, labels, per_class=3)
    assert seen and seen[0] <= 6


def plain_scores(train_texts, labels, test_texts, strength=toxicity.STRENGTH, l2=1e-4, rounds=120):
    """Scores of the same loss minimised by the same steps, with one dense row of 0 and 1 a text and no hashing of rows."""
    words = [toxicity.words_of(t) for t in train_texts]
    changes, named = [toxicity.counterfactual_of(ws) for ws in words], [bool(ws & set(toxicity.SWAP)) for ws in words]
    twins = [ws - lacks | besides for ws, (lacks, besides) in zip(words, changes)]
    assert all({toxicity.SWAP.get(w, w) for w in ws} == twin for ws, twin, has in zip(words, twins, named) if has)
    ids = lambda ws: np.array([i for w in sorted(ws) for i in toxicity.feature_ids(w)])
    y, named = np.array(labels, float), np.array(named)
    held = np.zeros((2, 1 << toxicity.FEATURE_BITS)) + 0.5
    for ws, label in zip(words, labels):
        for i in set(ids(ws).tolist()):
            held[label, i] += 1
    n1, n0 = y.sum(), (1 - y).sum()
    odds = np.log(held[1] / (n1 + 1 - held[1])) - np.log(held[0] / (n0 + 1 - held[0]))
    seen = (np.abs(odds) >= 5 * np.sqrt(1 / held[1] + 1 / held[0])) | (held[1] >= 5) & (held[0] < 1) & (odds > 2.5) | (held[0] >= 5) & (held[1] < 1) & (odds < -2.5)
    used = np.flatnonzero(seen)
    grid = lambda sets: np.array([[(ids(ws) == u).sum() for u in used] for ws in sets], float)
    x, x2, x3 = grid(words), grid(twins), grid([toxicity.words_of(t) for t in test_texts])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    w, b = np.zeros(len(used)), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    m = v = np.zeros(len(used) + 1)
    share = np.where(named, 1 / max(named.sum(), 1), 1 / max((~named).sum(), 1))
    for t in range(1, rounds + 1):
        p, p2 = sigmoid(x @ w + b), sigmoid(x2 @ w + b)
        log_loss, pull = (p - y) / len(y), 2 * strength * share * (p - p2)
        one, two = log_loss + pull * p * (1 - p), -pull * p2 * (1 - p2)
        g = np.append(x.T @ one + x2.T @ two + 2 * l2 * w, one.sum() + two.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        step = 0.08 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return sigmoid(x3 @ w + b), used, x, x2


def test_scores_equal_a_plain_fit(spark):
    rng = random.Random(41)
    own = texts(rng, 120, False, 0.3) + texts(rng, 120, True, 0.5) + ["youngster elderberry stranger " + t for t in texts(rng, 60, True, 0)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(len(own))], "doc_id long, toxic int")
    kept = [r.doc_id for r in docs.filter(~toxicity.held_out("doc_id")).orderBy("doc_id").collect()]
    fresh = texts(rng, 40, False, 1.0) + texts(rng, 40, True, 0.5) + ["", "young elderly straight people"]
    tests = spark.createDataFrame(list(enumerate(fresh)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(tests, toxicity.train(docs, labels)).collect()}
    want, used, x, x2 = plain_scores([own[i] for i in kept], [int(i >= 120) for i in kept], fresh)
    assert len(used) > 10 and (x != x2).any()  # the penalty has something to do
    assert np.abs(np.array([got[i] for i in range(len(fresh))]) - want).max() < 1e-5


def test_the_penalty_acts_on_the_given_tables(spark):
    """No sampled row names a group there; terms that share beginnings with other words are put in, so weights change."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    with_it, without = toxicity.train(docs, labels), toxicity.train(docs, labels, counterfactual=0.0)
    change = lambda m: max(abs(float(m.weights[toxicity.feature_ids(t)].sum())) for t in toxicity.TERMS)
    assert change(with_it) <= change(without)
