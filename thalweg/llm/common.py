"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows is hot. Fewer than HOT_SHARE keys can be, so a table with a row for
#: each hot key is small at every size of the input.
HOT_SHARE = 512
#: Rows and bytes of one batch on its way to a Python worker at most: buffers on both sides are of this size, not of a partition's.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one if it is unset and the master local (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="thalweg-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def size_of(setting: str) -> int:
    """The number of a setting like 1024, 67108864b or 4m."""
    digits = setting.lower().removesuffix("b")
    power = "kmgt".find(digits[-1]) + 1
    return int(digits[:-1] if power else digits) << (10 * power)


def bound_batches(spark: SparkSession) -> dict[str, str]:
    """From now on batches of at most BATCH_ROWS rows and BATCH_BYTES bytes, or of what the session sets if that is less; the settings before."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name) for name in most}
    for name, n in most.items():
        if not 0 < size_of(before[name]) <= n:
            spark.conf.set(name, n)
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """bound_batches until the block ends."""
    before = bound_batches(spark)
    try:
        yield
    finally:
        for name, own in before.items():
            spark.conf.set(name, own)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def join_hot(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """Inner join of many rows to one row per key, where a few keys may hold most rows.

    groups has the number of its rows in `size`. Hot keys (see HOT_SHARE) are fewer than HOT_SHARE, so they are
    broadcast and their rows stay where they are; the others are shuffled as usual.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) * HOT_SHARE > total)
    cold = groups.filter(F.col(size) * HOT_SHARE <= total)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, keys: list[Column], kept: DataFrame) -> DataFrame:
    """The rows of docs whose keys are in kept, all columns under their own names; of rows with equal keys exactly one.

    keys says how docs gives them; kept has them as its columns, in that order. Rows with equal keys are
    interchangeable (the keys cover the identifier and the whole text), so any one of them may stay.
    """
    names = [fresh(docs, f"key{i}") for i in range(len(keys))]
    kept = kept.toDF(*names)
    held = docs.withColumns(dict(zip(names, keys, strict=True)))
    twins = materialize(held.groupBy(*names).count().filter("count > 1").select(*names), "twins")
    out = held.join(kept.select(*names).distinct(), names, "left_semi")
    if not twins.isEmpty():
        again = out.join(twins, names, "left_semi").dropDuplicates(names)
        out = out.join(twins, names, "left_anti").unionByName(again)
    return out.drop(*names)
