"""Kernels that run basin by basin, and what becomes of basins in which one fails."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import cut
from .lots import by_lots, changes

FAILURE = "basin_id long, stage string, error_kind string, error string"


class Failures:
    """Basins that failed in one run, each at the first kernel that it broke."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def found(self, spark: SparkSession) -> DataFrame:
        """basin_id, stage, error_kind (the exception's name), error: one row for each basin that failed."""
        out = spark.createDataFrame([], FAILURE)
        for t in self.tables:
            out = out.unionByName(t)
        return out.groupBy("basin_id").agg(F.min(F.struct("stage", "error_kind", "error")).alias("e")).select("basin_id", "e.*")


def guarded(run: Callable[[pd.DataFrame], pd.DataFrame], names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """run with columns _kind and _error: null, or in the one row of a basin that failed what went wrong."""

    def safe(basin: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(basin).assign(_kind=None, _error=None)
        except Exception as e:  # whatever a basin's data does to the kernel
            row = dict.fromkeys(names) | {"basin_id": basin["basin_id"].iloc[0], "_kind": type(e).__name__, "_error": f"{type(e).__name__}: {e}"}
            return pd.DataFrame([row], columns=[*names, "_kind", "_error"])

    return safe


def each_basin(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run for each basin of rows, as applyInPandas has it; rows are converted many basins at a time, which costs more than small kernels do."""
    to = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def lot(part: pa.Table) -> pa.Table:
        starts = np.flatnonzero(changes(part, ["basin_id"])).tolist()
        spans = list(zip(starts, [*starts[1:], len(part)], strict=True))
        if any(column.null_count for column in part.columns):  # a null must not change the types of other basins
            basins = (part.slice(a, b - a).to_pandas() for a, b in spans)
        else:
            held = part.to_pandas()
            basins = (held.iloc[a:b].reset_index(drop=True) for a, b in spans)
        done: dict[bool, list[pd.DataFrame]] = {False: [], True: []}
        for basin in basins:
            made = run(basin)
            if len(made):
                done["_error" in made and made["_error"].iloc[0] is not None].append(made)
        made = [pa.Table.from_pandas(pd.concat(x, ignore_index=True)[to.names], schema=to, preserve_index=False) for x in done.values() if x]
        return pa.concat_tables(made) if made else to.empty_table()

    return by_lots(rows, ["basin_id"], [], lot, schema)


def per_basin(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, failures: Failures | None = None, stage: str = "") -> DataFrame:
    """run for each basin of rows. With failures, basins that break it are noted there and are gone from the result, so later stages don't meet them."""
    if failures is None:
        return each_basin(rows, run, schema)
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]
    tried = cut(each_basin(rows, guarded(run, names), schema + ", _kind string, _error string"), stage)
    failures.tables.append(tried.filter("_error IS NOT NULL").select("basin_id", F.lit(stage).alias("stage"), F.col("_kind").alias("error_kind"), F.col("_error").alias("error")))
    return tried.filter("_error IS NULL").drop("_kind", "_error")
