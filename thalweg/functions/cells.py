"""Scalar algebra on grid cells and neighbour masks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Neighbours (row step, column step); a neighbour's bit in a mask is its place here. Rows grow to the south.
STEPS = {"N": (-1, 0), "E": (0, 1), "S": (1, 0), "W": (0, -1), "NE": (-1, 1), "SE": (1, 1), "SW": (1, -1), "NW": (-1, -1)}
BIT = {name: 1 << i for i, name in enumerate(STEPS)}
SIDES, CORNERS = ("N", "E", "S", "W"), ("NE", "SE", "SW", "NW")
#: Cells of a forked junction, and for each side its two opposite corners.
FORKS = (("W", "S", "NE"), ("W", "N", "SE"), ("N", "E", "SW"), ("E", "S", "NW"))
OPPOSITE = {"N": ("SE", "SW"), "E": ("NW", "SW"), "S": ("NE", "NW"), "W": ("NE", "SE")}


def probability(pct: Column, is_ref: Column) -> Column:
    """Share of 1 from per cent; reference water is certain."""
    return F.when(is_ref, F.lit(1.0)).otherwise(pct / 100.0)


def water(prob: Column, at_least: float = 0.5) -> Column:
    return (prob >= at_least).cast("int")


def elevation(raw: Column, limit: int = 32768, instead: int = 10000) -> Column:
    return F.when(raw >= limit, F.lit(instead)).otherwise(raw.cast("int"))


@F.pandas_udf(DoubleType())
def minus_log2(shares: pd.Series) -> pd.Series:
    """-log2 between 0 and 1, else 0, by the C library: Spark's log2 divides logarithms and is off in the last bit, which moves ways that end at a cutoff."""
    return pd.Series([-math.log2(x) if 0.0 < x < 1.0 else 0.0 for x in shares.tolist()], dtype="float64")


def cost_weight(prob: Column, low: float = 0.1, high: float = 0.5) -> Column:
    """0 where water is sure or out of the question, else -log2 of the probability's place between low and high."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (prob - low) / (high - low)))
    return minus_log2(scaled)


def step_cost(weight: Column, elev_from: Column, elev_to: Column, most: int = 20) -> Column:
    """Of a step away from the river: descending costs, more than `most` is barred."""
    drop = F.greatest(F.lit(0), elev_from - elev_to)
    return F.when(drop > most, F.lit(1e30)).when(drop == 0, F.greatest(weight, F.lit(0.0))).otherwise(F.greatest(weight * drop, drop.cast("double")))


def midpoint(row: Column, col: Column, west: float, north: float, size: float) -> Column:
    return F.struct((west + size * (col + 0.5)).alias("x"), (north - size * (row + 0.5)).alias("y"))


def has(mask: Column, *names: str) -> Column:
    bits = sum(BIT[n] for n in names)
    return mask.bitwiseAND(F.lit(bits)) == bits


def count_of(mask: Column, names: tuple[str, ...] | None = None) -> Column:
    return F.bit_count(mask if names is None else mask.bitwiseAND(F.lit(sum(BIT[n] for n in names))))


def is_fork(mask: Column) -> Column:
    out = F.lit(False)
    for cells in FORKS:
        out = out | has(mask, *cells)
    return out


def is_bent_end(mask: Column) -> Column:
    out = F.lit(False)
    for side, corners in OPPOSITE.items():
        out = out | (has(mask, side) & (has(mask, corners[0]) | has(mask, corners[1])))
    return out


def removal_class(mask: Column) -> Column:
    """interior, candidate or keep, by which of the eight neighbours are water."""
    n = count_of(mask, SIDES)
    straight = (mask.bitwiseAND(F.lit(15)) == BIT["N"] + BIT["S"]) | (mask.bitwiseAND(F.lit(15)) == BIT["E"] + BIT["W"])
    candidate = (n == 3) | ((n == 2) & ~straight & ~is_fork(mask)) | ((n == 1) & (count_of(mask, CORNERS) > 0) & ~is_bent_end(mask))
    return F.when(n == 4, F.lit("interior")).when(candidate, F.lit("candidate")).otherwise(F.lit("keep"))
