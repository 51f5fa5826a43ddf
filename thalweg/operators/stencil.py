"""Neighbourhood operators on sparse grids: one shuffle of cells by basin, and sums in its tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import BIT, SIDES, STEPS

CELL = ["basin_id", "r", "c"]


def around(cells: DataFrame, aggregates: list[Column], keep: list[str], steps: tuple[str, ...] = tuple(STEPS)) -> DataFrame:
    """keep and the aggregates of each cell. They are over its neighbours' columns, the neighbour's `bit`, and `own` (the cell itself).

    A missing neighbour counts as nothing, and places without a cell of their own get no row. Cells are shuffled by basin
    before they are sent, so a task sums all that is sent to a place, and the copies themselves are never shuffled or held.
    """
    offsets = [(0, 0, 0), *((STEPS[n][0], STEPS[n][1], BIT[n]) for n in steps)]
    to = F.explode(F.array(*[F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(bit).alias("bit")) for dr, dc, bit in offsets]))
    sent = cells.repartition("basin_id").select("*", to.alias("to")).withColumns({"r": F.col("r") + F.col("to.dr"), "c": F.col("c") + F.col("to.dc"), "bit": F.col("to.bit"), "own": F.col("to.bit") == 0})
    held = [F.max(F.when(F.col("own"), F.col(k))).alias(k) for k in keep]
    return sent.groupBy(*CELL).agg(*held, *aggregates, F.max("own").alias("_there")).filter("_there").drop("_there")


def neighbour_mask(cells: DataFrame, flag: str, keep: list[str]) -> DataFrame:
    """mask: bits of the eight neighbours whose flag is 1."""
    return around(cells, [F.sum(F.when(~F.col("own") & (F.col(flag) == 1), F.col("bit")).otherwise(0)).cast("int").alias("mask")], keep)


def neighbour_count(cells: DataFrame, flag: str, keep: list[str], sides_only: bool = False) -> DataFrame:
    steps = SIDES if sides_only else tuple(STEPS)
    return around(cells, [F.sum(F.when(~F.col("own") & (F.col(flag) == 1), 1).otherwise(0)).alias("n")], keep, steps)


def mean_elevation(cells: DataFrame, keep: list[str]) -> DataFrame:
    """mean_elev over the cell and those of its eight neighbours that there are."""
    return around(cells, [F.avg("elev").alias("mean_elev")], keep)


def touching(cells: DataFrame, keep: list[str]) -> DataFrame:
    """Cells of water that is not reference water, beside some that is."""
    found = around(cells, [F.max(F.when(~F.col("own"), F.col("is_ref")).otherwise(F.lit(False))).alias("beside")], [*keep, "is_ref", "water"])
    return found.filter("beside AND NOT is_ref AND water = 1").drop("beside", "is_ref", "water")
