"""Counterfactual-regularised toxicity classifier.

A logistic model over hashed word features (each distinct word, and its beginnings, which stand for inflected forms).
It is fitted on a bounded sample of labelled rows. Every sampled text that names a group of people also comes with its
identity terms swapped for those of another group, every other one with a term put in; the squared difference of the
two scores is part of the loss, so the model cannot lean on the mention itself, or on what a term shares with other
words, and neutral mentions of a group are not taken for attacks on it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import in_parts
from .common import small_batches, text_of

FEATURE_BITS = 19
BEGINNINGS = (4, 5, 6, 8)
MOST_WORDS = 100_000
AT_ONCE = 512  #: rows whose texts are Python strings at once
WORD = re.compile(r"\w+")
#: Identity terms, in rows whose terms are swapped for one another.
IDENTITY_TERMS = (
    "women men girls boys",
    "woman man girl boy",
    "muslims christians jews hindus atheists buddhists catholics",
    "muslim christian jewish hindu atheist buddhist catholic",
    "gay straight lesbian bisexual transgender queer",
    "black white asian latino african european",
    "immigrants refugees natives foreigners",
    "frauen männer mädchen jungen",
    "femmes hommes filles garçons",
    "mujeres hombres chicas chicos",
    "disabled elderly young blind deaf",
)
SWAP = {w: row[(i + 1) % len(row)] for row in map(str.split, IDENTITY_TERMS) for i, w in enumerate(row)}

TERMS = sorted(SWAP)
#: Weight of the penalty on score changes against the log loss.
STRENGTH = 20.0


def feature_ids(word: str) -> list[int]:
    forms = [f"={word}", *(f"{k}{word[:k]}" for k in BEGINNINGS if len(word) >= k)]
    return [zlib.crc32(x.encode()) & ((1 << FEATURE_BITS) - 1) for x in forms]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def counterfactual_of(words: set[str]) -> tuple[set[str], set[str]]:
    """What the twin of a text lacks and has besides: its identity terms swapped, or one put in if there is none."""
    if words.isdisjoint(SWAP):
        return set(), {TERMS[zlib.crc32(" ".join(sorted(words)).encode()) % len(TERMS)]}
    twin = {SWAP.get(w, w) for w in words}
    return words - twin, twin - words


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self):
        """text -> score; remembers what each word adds."""
        known: dict[str, float] = {}

        def score(text: str) -> float:
            if len(known) > MOST_WORDS:
                known.clear()
            total = self.bias
            for w in words_of(text):
                if (x := known.get(w)) is None:
                    x = known[w] = float(self.weights[feature_ids(w)].sum())
                total += x
            return 1 / (1 + np.exp(-min(max(total, -30), 30)))

        return score


def rows_to_matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(r) for r in rows], np.int64)
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), counts)


def fit(features: list[np.ndarray], lacks: list[np.ndarray], besides: list[np.ndarray], named: np.ndarray, labels: np.ndarray, sample_weights: np.ndarray | None = None, counterfactual: float = STRENGTH, l2: float = 1e-4, rounds: int = 120, evidence: float = 5.0) -> Model:
    """Logistic regression by Adam on the whole sample: log loss + l2 |w|^2 + counterfactual * mean (score - twin's score)^2.

    A twin has a row's features but those in lacks, and those in besides. The mean is that of the rows that name a group
    (named) plus that of the others, so neither kind thins the other out.
    Only features whose log odds between the classes lie `evidence` standard errors from zero get a weight, so words
    that are merely rare don't. The result depends on the sample alone.
    """
    size, n = 1 << FEATURE_BITS, len(features)
    c1, c0 = np.full(size, 0.5), np.full(size, 0.5)
    for f, label in zip(features, labels, strict=True):  # numbers of rows, not of words
        (c1 if label == 1 else c0)[np.unique(f)] += 1
    n1, n0 = max(int((labels == 1).sum()), 1), max(int((labels == 0).sum()), 1)
    odds = np.log(c1 / (n1 + 1 - c1)) - np.log(c0 / (n0 + 1 - c0))
    seen = np.abs(odds) >= evidence * np.sqrt(1 / c1 + 1 / c0)
    seen |= (c1 >= 5) & (c0 < 1) & (odds > 2.5) | (c0 >= 5) & (c1 < 1) & (odds < -2.5)
    (ids, of), (ids_lack, of_lack), (ids_more, of_more) = (rows_to_matrix([f[seen[f]].astype(np.int64) for f in part]) for part in (features, lacks, besides))
    used, every = np.unique(np.concatenate([ids, ids_lack, ids_more]), return_inverse=True)
    ids, ids_lack, ids_more = np.split(every, np.cumsum([len(of), len(of_lack)]))
    y = labels.astype(np.float64)
    sw = np.ones(n) if sample_weights is None else sample_weights
    sw = sw / max(sw.sum(), 1e-9)
    w, b = np.zeros(len(used)), float(np.log((np.sum(sw * y) + 1e-3) / (np.sum(sw * (1 - y)) + 1e-3)))
    m = np.zeros(len(used) + 1)
    v = np.zeros(len(used) + 1)
    share = np.where(named, 1 / max(int(named.sum()), 1), 1 / max(int((~named).sum()), 1))
    for t in range(1, rounds + 1):
        z = np.bincount(of, w[ids], minlength=n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = sw * (p - y)
        grad = np.bincount(ids, slope[of], minlength=len(used)) + 2 * l2 * w
        grad_b = slope.sum()
        z2 = z - np.bincount(of_lack, w[ids_lack], minlength=n) + np.bincount(of_more, w[ids_more], minlength=n)
        p2 = 1 / (1 + np.exp(-np.clip(z2, -30, 30)))
        d = 2 * counterfactual * share * (p - p2)
        down, up = d * p * (1 - p), -d * p2 * (1 - p2)
        grad += np.bincount(ids, (down + up)[of], minlength=len(used))
        grad += np.bincount(ids_more, up[of_more], minlength=len(used)) - np.bincount(ids_lack, up[of_lack], minlength=len(used))
        grad_b += down.sum() + up.sum()
        g = np.append(grad, grad_b)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, b)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, counterfactual: float = STRENGTH) -> Model:
    """Fit on at most `per_class` labelled rows of each class that are not held out: those of smallest hashed identifier.

    That bound (8,000 rows by default) is all that reaches the driver, and one row of each identifier, whatever repeats:
    of repeated labels the larger counts, of repeated documents the text of least hash. Without labels the model scores
    0.5 everywhere. Null identifiers, labels other than 0 and 1, and other columns take no part.
    """
    ok = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    totals = {r._label: r["count"] for r in ok.groupBy("_label").count().collect()}
    sample = None
    for label in (0, 1):
        part = ok.filter(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}

        def ids(words: set[str]) -> bytes:
            if len(known) > MOST_WORDS:
                known.clear()
            return np.array([i for w in words for i in (known.get(w) or known.setdefault(w, feature_ids(w)))], "<u4").tobytes()

        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            lacks, besides = zip(*map(counterfactual_of, words), strict=True) if words else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(map(ids, x), pa.binary()) for x in (words, lacks, besides)), pa.array([not w.isdisjoint(SWAP) for w in words], pa.bool_())], ["_id", "_label", "features", "lacks", "besides", "named"])

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    rows = rows.groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("_id", "_text", "_label")
    with small_batches(docs.sparkSession):
        got = rows.mapInArrow(extract, "_id long, _label int, features binary, lacks binary, besides binary, named boolean").toArrow().sort_by([("_id", "ascending"), ("features", "ascending")])
    if not got.num_rows:
        return Model(np.zeros(1 << FEATURE_BITS, np.float32), 0.0)
    of_bytes = lambda x: np.frombuffer(x.as_buffer(), "<u4")
    y = got["_label"].to_numpy()
    taken = {k: max(int((y == k).sum()), 1) for k in (0, 1)}
    weight = np.where(y == 1, totals.get(1, 0) / taken[1], totals.get(0, 0) / taken[0])  # as in all labelled rows
    columns = [list(map(of_bytes, got[c])) for c in ("features", "lacks", "besides")]
    model = fit(*columns, np.array(got["named"].to_pylist(), bool), y, weight, counterfactual)
    del columns, got
    pa.default_memory_pool().release_unused()  # the driver has no further use for the sample
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row, without a shuffle. A null or empty text gets the score of no words.

    Repeated rows get the same score each, texts are read whole, and an empty table gives none. Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value.scorer()
        for batch in batches:
            for names, texts in in_parts(batch):
                yield pa.RecordBatch.from_arrays([names, pa.array(list(map(scorer, texts)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows that score `threshold` or more."""
    schema = docs.schema
    at = schema.fieldNames().index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value.scorer()
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                yield part.filter(pa.array([scorer(t or "") < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
