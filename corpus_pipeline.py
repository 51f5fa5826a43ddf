"""The corpus pipeline: toxicity, exact copies, near copies, secrets, packing.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; what it returns is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents. Nothing is sampled but the labelled rows that the toxicity model is fitted on (a bound that
toxicity.train documents). Stages return plans that run later, so those that send texts to Python workers bound the
session's Arrow batches (bound_batches) for good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import exact_dedup, packing, secrets, simhash, toxicity
from thalweg.llm.common import bound_batches, fresh, materialize, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model learns from the labelled rows that are not held out."""
    bound_batches(spark)
    return toxicity.reject(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the row of smallest doc_id stays."""
    bound_batches(spark)
    return simhash.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and n_chars follows the new text."""
    spans = fresh(docs, "secret_spans")
    found = secrets.scan(docs, into=spans)
    hit = F.size(spans) > 0
    text = F.when(hit, secrets.redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    masked = found.withColumn("text", text).withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 4096 tokens."""
    bound_batches(spark)
    return packing.pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("secret_scan", mask_secrets), ("packing", pack)]

#: Word-piece ids and fingerprints have no form in SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
