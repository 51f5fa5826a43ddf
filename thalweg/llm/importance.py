"""Importance resampling towards a target distribution, over hashed n-grams whose CRCs are composed, never spelt out.

Features are the runs of one to three words. A feature's bucket is the CRC-32 of its bytes modulo BUCKETS. Each word's
CRC is computed once, and those of the longer runs follow by algebra: appending n bytes to a text multiplies its CRC by
a 32 x 32 matrix over GF(2), the n-th power of the matrix of one zero byte, so

    crc(a + b) = shift(len(b)) * crc(a)  xor  crc(b).

No n-gram string exists at any time. Bucket counts are summed in each task before they are shuffled; the gains of the
buckets, a table of fixed size, are all that the second pass over the texts needs. Texts are never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import in_parts
from .common import fresh, materialize, partitions, text_of

BUCKETS, LONGEST = 10_000, 3
POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed
#: Word bytes stay (letters in lower case), all others become spaces: digits, letters and whatever is not ASCII are word bytes.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
LOW = 256


def by_bytes(columns: np.ndarray) -> np.ndarray:
    """Tables [..., 4, 256] of the matrices [..., 32] (a column a bit): a product is the xor of four look-ups."""
    out = np.zeros((*columns.shape[:-1], 4, 256), np.uint32)
    for part in range(4):
        for bit in range(8):
            out[..., part, 1 << bit : 2 << bit] = out[..., part, : 1 << bit] ^ columns[..., 8 * part + bit, None]
    return out


@lru_cache(maxsize=1)
def shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables of the shifts by 0 to LOW - 1 bytes, and of those by LOW, 2 * LOW, 4 * LOW... bytes."""
    of_byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        of_byte = (of_byte >> 1) ^ np.where(of_byte & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    columns = [np.uint32(1) << np.arange(32, dtype=np.uint32)]
    for _ in range(LOW):
        columns.append((columns[-1] >> np.uint32(8)) ^ of_byte[columns[-1] & 255])
    doubled = [columns[LOW]]
    for _ in range(23):
        doubled.append(product(by_bytes(doubled[-1]), doubled[-1]))
    return by_bytes(np.array(columns[:LOW])), by_bytes(np.array(doubled))


def product(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def shifted(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as its size says."""
    near, far = shift_tables()
    low, high = sizes & (LOW - 1), sizes >> 8
    out = near[low, 0, crc & 255] ^ near[low, 1, (crc >> 8) & 255] ^ near[low, 2, (crc >> 16) & 255] ^ near[low, 3, crc >> 24]
    for k in range(int(high.max(initial=0)).bit_length()):
        at = np.flatnonzero((high >> k) & 1)
        out[at] = product(far[k], out[at])
    return out


def feature_crcs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all features of the texts, the text of each, and the number of words of each text."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.translate(WORD_BYTES).split()
        words += own
        counts[i] = len(own)
    n = len(words)
    crc, size = np.fromiter(map(zlib.crc32, words), np.uint32, n), np.fromiter(map(len, words), np.int64, n)
    of = np.repeat(np.arange(len(texts)), counts)
    behind = shifted(np.full(n, zlib.crc32(b" "), np.uint32), size) ^ crc  # of a space and the word
    runs, owners, last = [crc], [of], crc
    for k in range(1, LONGEST):
        last = shifted(last[:-1], size[k:] + 1) ^ behind[k:]  # a run and the word after it
        whole = of[k:] == of[: n - k] if n > k else np.zeros(0, bool)
        runs.append(last[whole])
        owners.append(of[k:][whole])
    return np.concatenate(runs), np.concatenate(owners), counts


def bytes_in_parts(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[pa.Array, list[bytes]]]:
    return in_parts(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary())], ["key", "text"]), size)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n of the features of all texts; a task sends a row for each of its buckets, however many texts it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in bytes_in_parts(batch):
                total += np.bincount(feature_crcs(texts)[0] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    parts = docs.select(F.lit(0).alias("key"), text_of(text_col).alias("text")).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain (long) of every bucket: floor(1000 * ln of the smoothed target share over the smoothed share in docs)."""
    spark = docs.sparkSession
    own, other = bucket_counts(docs, text_col, buckets).withColumnRenamed("n", "s"), bucket_counts(target, target_text_col, buckets).withColumnRenamed("n", "t")
    held = materialize(spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(own, "bucket", "left").join(other, "bucket", "left").na.fill(0, ["s", "t"]), "bucket-counts")
    total = held.agg(F.sum("s").cast("double"), F.sum("t").cast("double")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    return held.select("bucket", F.floor(1000 * F.ln((t + 1) * F.lit(total[0] + buckets) / ((s + 1) * F.lit(total[1] + buckets)))).alias("gain"))


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, texts in bytes_in_parts(batch):
                crcs, of, words = feature_crcs(texts)
                weight = np.zeros(len(texts), np.int64)
                np.add.at(weight, of, gains[crcs % np.uint32(len(gains))])
                features = np.bincount(of, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([names, pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) of the identifier's own u in (0, 1): with it, the highest scores are a draw by weight."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u)))


def numbered(rows: DataFrame, order: list[Column], keys: list[str], n: int) -> DataFrame:
    """keys and rank (from 1) of the first n rows in the given order, which must not leave ties open.

    A range sort deals the rows out, the counts of its partitions (a row for each) are added up, and the rows of each
    partition are numbered from there.
    """
    spark = rows.sparkSession
    placed = materialize(rows.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "ranked")
    base, bases = 0, []
    for part, count in placed.groupBy("part").count().orderBy("part").collect():
        bases.append((part, base))
        base += count
    before = spark.createDataFrame(bases, "part int, base long").filter(F.col("base") < n)
    own = placed.join(F.broadcast(before), "part").withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return own.filter(F.col("rank") <= n).select(*keys, "rank")


def scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", least_words: int = 20, per_cent: int = 5, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of docs.

    Of the N rows with at least least_words words, floor(per_cent * N / 100) of the highest scores are drawn, ties to
    the smaller identifier, null identifiers last, then to the row of fewer features; rows that are the same in all of
    these take ranks in either order. A null or empty text has no feature and weight 0. Repeated rows count and are
    drawn each on their own. Texts are read whole, however long. An empty table, or one without target texts, works:
    counts are smoothed. Other columns of both tables are ignored, whatever their names are.
    """
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in bucket_gains(docs, target, text_col, target_text_col, buckets).collect():  # as many rows as buckets
        gains[bucket] = gain
    rows = weigh(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("row_no", F.monotonically_increasing_id())
    rows = materialize(rows, "weights")
    able = rows.filter(F.col("n_words") >= least_words)
    n = per_cent * able.count() // 100
    drawn = numbered(able.select("row_no", "score", "doc_id", "n_features"), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row_no")], ["row_no"], n)
    return rows.join(drawn, "row_no", "left").select("doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of docs, all columns, where identifiers are unique; rows of one identifier are drawn together."""
    name = fresh(docs, "drawn_id")
    drawn = scores(docs, target, id_col, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drawn, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_semi")
