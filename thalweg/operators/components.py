"""Connected water and land of basins, and the rules by which components stay or go."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grids import component_labels
from .guard import Failures, per_basin
from .stencil import CELL, mean_elevation


def label(cells: DataFrame, kind: str = "water", as_: str = "comp", failures: Failures | None = None) -> DataFrame:
    """cells with the label of each cell's component (see grids.component_labels); one task holds one basin."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema if f.name != as_), f"{as_} long"])

    def run(basin: pd.DataFrame) -> pd.DataFrame:
        own = component_labels(basin["r"].to_numpy(), basin["c"].to_numpy(), basin[kind].to_numpy())
        return basin.drop(columns=as_, errors="ignore").assign(**{as_: own})

    return per_basin(cells, run, schema, failures, "label")


def stats(labelled: DataFrame) -> DataFrame:
    return labelled.filter("comp <> 0").groupBy("basin_id", "comp").agg(F.count("*").alias("n_cells"), (F.max("elev") - F.min("elev")).cast("long").alias("elev_range"))


def main_component(labelled: DataFrame) -> DataFrame:
    """basin_id, main: the least label under reference water, -1 without any."""
    return labelled.groupBy("basin_id").agg(F.coalesce(F.min(F.when(F.col("is_ref") & (F.col("comp") > 0), F.col("comp"))), F.lit(-1)).alias("main"))


def merge_main(labelled: DataFrame) -> DataFrame:
    """All water components that touch reference water become the main one."""
    touched = labelled.filter("is_ref AND comp > 0").select("basin_id", "comp").distinct().withColumn("of_main", F.lit(True))
    out = labelled.join(main_component(labelled), "basin_id").join(touched, ["basin_id", "comp"], "left")
    return out.withColumn("comp", F.when(F.col("of_main"), F.col("main")).otherwise(F.col("comp"))).drop("of_main")


def lowest_cell(labelled: DataFrame) -> DataFrame:
    """Of each water component the cell of least mean elevation; ties go to the first in row-major order."""
    mean = mean_elevation(labelled, ["comp", "in_basin"]).filter("comp > 0")
    low = mean.groupBy("basin_id", "comp").agg(F.min(F.struct("mean_elev", "r", "c", "in_basin")).alias("low"))
    return low.select("basin_id", "comp", "low.r", "low.c", "low.in_basin")


def prune_outside(labelled: DataFrame, share: float = 0.75) -> DataFrame:
    """Water cells inside the basin, of components that are main, lie inside by more than `share`, or have their lowest cell inside."""
    main = main_component(labelled)
    inside = labelled.filter("comp > 0").groupBy("basin_id", "comp").agg(F.avg(F.col("in_basin").cast("int")).alias("inside"))
    low = lowest_cell(labelled).select("basin_id", "comp", F.col("in_basin").alias("low_inside"))
    kept = inside.join(low, ["basin_id", "comp"]).join(main, "basin_id").filter((F.col("comp") == F.col("main")) | (F.col("inside") > share) | F.col("low_inside"))
    return labelled.filter("comp > 0 AND in_basin").join(kept.select("basin_id", "comp"), ["basin_id", "comp"], "left_semi")


def fill_small_land(labelled: DataFrame, tiny: int = 20, small: int = 400, flat: int = 4) -> DataFrame:
    """water becomes 1 in land components of fewer than `tiny` cells, or than `small` with an elevation range under `flat`."""
    land = stats(labelled.filter("comp < 0")).filter((F.col("n_cells") < tiny) | ((F.col("n_cells") < small) & (F.col("elev_range") < flat)))
    out = labelled.join(land.select("basin_id", "comp", F.lit(True).alias("filled")), ["basin_id", "comp"], "left")
    return out.withColumn("water", F.when(F.col("filled"), 1).otherwise(F.col("water"))).drop("filled")


def drop_small_water(labelled: DataFrame, least: int = 8) -> DataFrame:
    """Water cells of components of `least` cells or more."""
    kept = labelled.filter("comp > 0").groupBy("basin_id", "comp").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return labelled.filter("comp > 0").join(kept.select("basin_id", "comp"), ["basin_id", "comp"], "left_semi")


__all__ = ["CELL", "drop_small_water", "fill_small_land", "label", "lowest_cell", "main_component", "merge_main", "prune_outside", "stats"]
