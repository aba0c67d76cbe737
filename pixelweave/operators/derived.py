"""Layers derived from others: masks, forest at a year, distances, climate of a year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.operators.distance import distance_to
from pixelweave.sources.layers import rasterize

# The years of settlement data, thresholds of a settlement, and the states of a protected area that count.
EPOCHS = tuple(range(1975, 2021, 5))
SETTLED_POPULATION, SETTLED_SURFACE = 15, 90
PROTECTED = ("Designated", "Inscribed", "Established", "Proposed")


def closest_epoch(year: Column, epochs: tuple[int, ...] = EPOCHS) -> Column:
    """The epoch nearest to a year, the earlier one of two."""
    from_year = F.transform(F.array(*map(F.lit, epochs)), lambda e: F.struct(F.abs(e - year).alias("d"), e.alias("e")))
    return F.array_min(from_year)["e"]


def settlement(population: Column, built: Column) -> Column:
    """1 where both reach the thresholds, 0 elsewhere, NULL values included."""
    return F.coalesce((population >= SETTLED_POPULATION) & (built >= SETTLED_SURFACE), F.lit(False)).cast("int")


def settled_at(px: DataFrame, year: int) -> DataFrame:
    """``(row, col, value)`` from ``px (row, col, epoch, population, built)`` at the epoch nearest to the year."""
    return px.filter(F.col("epoch") == closest_epoch(F.lit(year))).select("row", "col", settlement(F.col("population"), F.col("built")).alias("value"))


def water(classes: Column) -> Column:
    """Classes from 2 are water; no data is none."""
    return F.coalesce((classes >= 2).cast("int"), F.lit(0))


def undisturbed(classes: Column) -> Column:
    """Forest of a map of change classes: class 1 alone; degraded forest (2) is none."""
    return F.when(classes.isNotNull(), (classes == 1).cast("int"))


def protected(px: DataFrame, polygons: DataFrame, n_rows: int, x0: float, y0: float, res: float, n_cols: int) -> DataFrame:
    """``(row, col, value)``: 1 at pixels of ``px`` in a polygon whose ``status`` counts, 0 at the others."""
    inside = rasterize(polygons.filter(F.col("status").isin(*PROTECTED)), n_rows, x0, y0, res, n_cols)
    return px.select("row", "col").join(inside, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0)).alias("value"))


def distance_layer(px: DataFrame, layer: str, kind: str, res: float) -> DataFrame:
    """``edge``: distance to the nearest 0 of a 0/1 layer; ``dist``: to the nearest 1. NULL where the layer is."""
    target = {"edge": 0, "dist": 1}[kind]
    out = distance_to(px, F.col(layer) == target, res, F.col(layer).isNotNull())
    return out.select("row", "col", F.col("dist").alias(f"{layer}_{kind}"))


def steady_sum(v: Column) -> Column:
    """The sum of doubles, the same in whatever order and parts they come: multiples of 2**-10, then of 2**-40, whose sums are
    exact up to 2**43 and, for 2**24 values, of the second; what is left is too small to move the last bit."""
    high = F.rint(v * 2.0**10) / 2.0**10
    mid = F.rint((v - high) * 2.0**40) / 2.0**40
    return F.sum(high) + (F.sum(mid) + F.sum(v - high - mid))


def year_of_climate(months: DataFrame, value: str, by: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Whole numbers from monthly rows: ``total`` (metres to millimetres), ``mean``, ``high``, ``low`` and ``median`` (Kelvin to
    Celsius), one row a pixel. A pixel has a row a month, so its median is exact and small. Sums do not depend on how the rows
    are dealt out, as the last bit of a mean decides where it lies halfway between two whole numbers."""
    v = F.col(value).cast("double")
    total = steady_sum(v)
    celsius = {"mean": F.try_divide(total, F.count(v)), "high": F.max(v), "low": F.min(v), "median": F.percentile(v, F.lit(0.5))}
    return months.groupBy(*by).agg(F.round(total * 1000).cast("int").alias("total"), *[F.round(c - 273.15).cast("int").alias(n) for n, c in celsius.items()])


def numbered(features: DataFrame, name: str) -> DataFrame:
    """Consecutive ids from 1 of the distinct values of ``name``, in their order: counts per range, so no task sees all."""
    from pixelweave.operators.ranks import positions

    return positions(features.select(name).filter(F.col(name).isNotNull()).distinct(), [], name).select(name, (F.col("_at") + 1).alias("id"))
