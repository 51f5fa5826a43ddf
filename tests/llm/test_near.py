"""Near copies of five-word shingles against brute force."""

import random

from thalweg.llm import near


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_copies_of_jaccard_080_to_095_go(spark):
    corpus_pipeline = __import__("pytest").importorskip("corpus_pipeline")
    rng, texts = random.Random(8), []
    for k in range(30):
        own = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts.append(" ".join(own))
        for _ in range(3):
            other = list(own)
            for i in rng.sample(range(300), k % 9 + 2):
                other[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    texts += ["", None, "one two", "ONE two", "one two three"]
    found = [sets(t) for t in texts]
    alike = lambda a, b: a and b and 10 * len(a & b) >= 8 * len(a | b)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(found[i], found[j])]
    assert any(0.8 <= len(found[i] & found[j]) / len(found[i] | found[j]) <= 0.85 for i, j in pairs)
    group = list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted(set(group))


def test_members_of_a_key_that_its_least_member_does_not_link(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:100] + [f"y{k}{i // 2}" if i % 2 else base[i] for i in range(100, 200)]) for k in range(3)]
    texts += [t + f" end{j}" for t in texts for j in range(4)]
    monkeypatch.setattr(near, "band_keys", lambda hashes: [7] if len(hashes) else [])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near.drop_near_copies(docs).collect()) == [0, 1, 2]
    assert near.drop_near_copies(docs.limit(0)).count() == 0


def groups_of(texts):
    found = [sets(t) for t in texts]
    group = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if found[i] and 10 * len(found[i] & found[j]) >= 8 * len(found[i] | found[j])]
    for _ in range(len(texts)):
        before = list(group)
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    return sorted(set(group)), len(pairs)


def test_large_groups_are_compared_by_tiles(spark, monkeypatch):
    """Copies of one text with a word or two changed in each, most of them below 0.8 from one another."""
    rng, base = random.Random(3), [f"w{i}" for i in range(46)]
    texts = []
    for k in range(150):
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(46)] = f"x{rng.randrange(30)}"
        texts.append(" ".join(own + ([f"end{k}"] if k % 3 else [])))
    kept, links = groups_of(texts)
    assert links > 10 and 3 < len(kept) < 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near, "band_keys", lambda hashes: [7] if len(hashes) else [])
    for large, tile in ((10**6, 512), (4, 512), (4, 20)):
        monkeypatch.setattr(near, "LARGE", large)
        monkeypatch.setattr(near, "TILE_SETS", tile)
        monkeypatch.setattr(near, "COLUMNS", 10 * tile)
        assert sorted(r.doc_id for r in near.drop_near_copies(docs).collect()) == kept
    monkeypatch.setattr(near.repeats, "MOST_KEYS", 0)
    assert sorted(r.doc_id for r in near.drop_near_copies(docs).collect()) == kept


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(5, text, "a"), (5, text, "b"), (7, text + " x", "c"), (None, text + " y", "d"), (9, None, "e"), (9, None, "f")], "doc_id long, text string, node string")
    out = near.drop_near_copies(docs).collect()
    assert sorted((r.doc_id, r.node in "ab" or r.node in "ef") for r in out) == [(5, True), (9, True)]


def test_hot_nodes_are_dealt_to_places(spark, monkeypatch):
    monkeypatch.setattr(near, "PLACE_ROWS", 7)
    rows = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 5), (3, 6)], "a long, x long").repartition(3)
    wide = spark.createDataFrame([(1, 100, "one"), (2, 1, "two"), (4, 0, "none")], "a long, count long, own string")
    assert sorted(map(tuple, near.join_salted(rows, wide, "a", "count").select("a", "x", "own").collect())) == [(1, i, "one") for i in range(100)] + [(2, 5, "two")]


def test_recall_of_pairs_near_the_threshold(spark):
    """Some thousand pairs of similarity 0.80 to 0.85, each pair in words of its own."""
    rng, texts, pairs = random.Random(80), [], 0
    for k in range(1500):
        own = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        other = list(own)
        for i in range(60 - rng.choice((5, 6)), 60):
            other[i] = f"x{rng.randrange(10**9)}"
        a, b = sets(" ".join(own)), sets(" ".join(other))
        assert 0.8 <= len(a & b) / len(a | b) <= 0.85
        texts += [" ".join(own), " ".join(other)]
        pairs += 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pairs == 1500 and near.drop_near_copies(docs).count() <= pairs + 2


def test_counts_of_common_elements(monkeypatch):
    import numpy as np

    rng = random.Random(9)
    monkeypatch.setattr(near, "COLUMNS", 7)
    a, b = ([np.array(sorted(rng.sample(range(60), rng.randint(0, 40))), np.uint64) for _ in range(n)] for n in (9, 5))
    assert near.common_counts(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_every_key_lies_in_one_family(spark):
    rng = random.Random(10)
    rows = {(rng.randrange(40), rng.randrange(100)) for _ in range(150)}
    members = spark.createDataFrame(sorted(rows), "key long, node long")
    of = {}
    for r in near.families_of(members).collect():
        of.setdefault(r.node, set()).add(r.family)
    for key in {k for k, _ in rows}:
        assert set.intersection(*(of[n] for k, n in rows if k == key))
