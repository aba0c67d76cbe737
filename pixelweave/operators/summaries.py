"""Counts, ranges and checks of layers and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.scalars import binary_round
from pixelweave.operators.ranks import quantiles
from pixelweave.sources.shared import small

MAX_CLASSES = 50
POLYGONS = ("Polygon", "MultiPolygon")
METRICS = ("RMSE", "wRMSE", "MedAE", "R2")


def class_counts(px: DataFrame, value: str) -> DataFrame:
    """``(value, n)`` of the valid pixels."""
    return px.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))


def class_table(px: DataFrame, value: str) -> DataFrame:
    """Counts of whole-number classes, keyed by long. A class that is no whole number raises: two of them could share a key."""
    v = F.col(value).cast("double")
    whole = F.when(v == F.floor(v), v.cast("long")).otherwise(F.raise_error(F.lit("classes must be whole numbers")).cast("long"))
    return px.filter(v.isNotNull()).select(whole.alias("strata")).groupBy("strata").agg(F.count("*").alias("n"))


def listed_counts(px: DataFrame, value: str, categories: DataFrame) -> DataFrame:
    """Counts over the list ``categories (cat)``, 0 for those without a pixel; other values are not counted."""
    n = px.groupBy(F.col(value).cast("long").alias("cat")).agg(F.count("*").alias("n"))
    return categories.select(F.col("cat").cast("long").alias("cat")).join(n, "cat", "left").fillna(0, ["n"])


def levels(px: DataFrame, value: str) -> DataFrame:
    """One row, the sorted distinct values. For categorical layers: the list is as long as there are categories."""
    return px.agg(F.sort_array(F.collect_set(F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))).alias("levels"))


def value_range(px: DataFrame, value: str) -> DataFrame:
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return px.agg(F.min(v).alias("least"), F.max(v).alias("most"))


def range_or_unit(px: DataFrame, value: str) -> DataFrame:
    """``value_range``, or 0 to 1 where no pixel has a value."""
    return value_range(px, value).select(F.coalesce("least", F.lit(0.0)).alias("least"), F.coalesce("most", F.lit(1.0)).alias("most"))


def all_nodata(px: DataFrame, value: str) -> DataFrame:
    return px.agg((F.count(value) == 0).alias("all_nodata"))


def binary_check(px: DataFrame, value: str) -> DataFrame:
    """One row: least and largest value, and whether the layer is 0/1 with a 1 in it."""
    bad = (F.min(value) < 0) | (F.max(value) > 1) | (F.max(value) == 0)
    return px.agg(F.min(value).alias("least"), F.max(value).alias("most"), (~F.coalesce(bad, F.lit(True))).alias("valid"))


def require_binary(px: DataFrame, value: str) -> None:
    """ValueError unless every value is 0 or 1 and some value is 1."""
    r = binary_check(px, value).first()
    if not r["valid"]:
        raise ValueError(f"layer {value!r} must hold 0 and 1 only, and 1 somewhere: it runs from {r['least']} to {r['most']}")


def class_domain(px: DataFrame, value: str, most: int = MAX_CLASSES) -> DataFrame:
    """One row: number of values, those that are no whole number, and whether they can be classes (some, whole, at most ``most``)."""
    v = F.col(value).cast("double")
    odd = F.count_if(F.isnan(v) | (v != F.floor(v)))
    n = F.count_distinct(v)
    return px.agg(n.alias("n_values"), odd.alias("n_not_whole"), ((n > 0) & (odd == 0) & (n <= most)).alias("valid"))


def vector_classes(features: DataFrame, name: str, most: int = MAX_CLASSES) -> DataFrame:
    """``(value, name)`` of polygons burned as unique ids, numbered by feature_id; a missing name is the number. No features,
    or more than ``most``, raise ValueError."""
    n = features.limit(most + 1).count()
    if not 0 < n <= most:
        raise ValueError(f"between 1 and {most} features are needed")
    from pyspark.sql import Window

    at = F.row_number().over(Window.orderBy("feature_id"))  # at most ``most`` rows
    return features.select("feature_id", name).withColumn("value", at).select(
        "value",
        F.coalesce(F.col(name).cast("string"), F.col("value").cast("string")).alias("name")
    )


def project_counts(px: DataFrame, cat: str, mask: Column) -> DataFrame:
    """Pixels of each category above 0 under a mask of 1."""
    return px.filter((mask == 1) & (F.col(cat) != 0)).groupBy(F.col(cat).cast("long").alias("cat")).agg(F.count("*").alias("npix"))


def uncovered(have: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Values of ``on`` in ``have`` that ``known`` lacks, each once."""
    return have.select(on).filter(F.col(on).isNotNull()).distinct().join(known.select(on).distinct(), on, "left_anti")


def densities(px: DataFrame, rates: DataFrame, cat: str = "risk") -> DataFrame:
    """``(row, col, dens)``: the density of each pixel's category, 0 where the rate table lacks it. Pixels are not shuffled."""
    return px.join(small(rates.select(F.col("cat").alias(cat), "defor_dens")), cat, "left").select("row", "col", F.coalesce("defor_dens", F.lit(0.0)).alias("dens"))


def split_by_target(points: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Points of the event (1) and the others (0)."""
    return points.filter(F.col(target) == 1), points.filter(F.col(target) == 0)


def finite(*values: str) -> Column:
    """Whether all of the columns hold a finite number."""
    out = F.lit(True)
    for v in values:
        c = F.col(v).cast("double")
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return out


def axis_bounds(points: DataFrame, x: str, y: str) -> DataFrame:
    """One domain for both columns: their finite range; 0 to 1 without a value or where all are 0; v - |v| to v + |v| where
    all are v."""
    each = points.select(F.explode(F.array(F.col(x).cast("double"), F.col(y).cast("double"))).alias("v")).filter(finite("v"))
    t = each.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    none = F.col("lo").isNull() | (flat & (F.col("lo") == 0))
    return t.select(
        F.when(none, 0.0).when(flat, F.col("lo") - F.abs("lo")).otherwise(F.col("lo")).alias("low"),
        F.when(none, 1.0).when(flat, F.col("hi") + F.abs("hi")).otherwise(F.col("hi")).alias("high"),
    )


def normalised(px: DataFrame, value: str, mask: Column, nodata: int = 65535) -> DataFrame:
    """``(row, col, value)`` over the largest value left, for comparing maps: no pixels under a mask of 0 or NULL, none of
    ``nodata``."""
    t = px.filter(F.coalesce(mask != 0, F.lit(False)) & (F.col(value) != nodata)).select("row", "col", F.col(value).cast("double").alias("v"))
    return t.crossJoin(F.broadcast(t.agg(F.max("v").alias("m")))).select("row", "col", F.try_divide("v", "m").alias("value"))  # one row


def shown_metrics(indices: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Index rows with the chosen metrics only; with none chosen, all."""
    return indices.drop(*[m for m in METRICS if m not in metrics]) if metrics else indices


def ordered_indices(indices: DataFrame) -> DataFrame:
    return indices.orderBy("csize", "period", "model")


def rounded_indices(indices: DataFrame) -> DataFrame:
    """Metrics to two digits of their binary value, halves to even, as they are written and shown."""
    return indices.select(*[binary_round(F.col(c), 2).alias(c) if c in METRICS else F.col(c) for c in indices.columns])


def effect_summary(effect: DataFrame, value: str = "rho") -> DataFrame:
    v = F.col(value)
    return effect.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def worst_mixing(diagnostics: DataFrame, by: tuple[str, ...] = ("kind",), most_rhat: float = 1.1, least_ess: float = 100.0) -> DataFrame:
    """Per group the largest R-hat and smallest effective size, and whether either is bad; groups without both are left out."""
    t = diagnostics.groupBy(*by).agg(F.max("rhat").alias("rhat"), F.min("ess").alias("ess")).filter("rhat IS NOT NULL AND ess IS NOT NULL")
    return t.withColumn("bad", (F.col("rhat") > most_rhat) | (F.col("ess") < least_ess))


def recovered_totals(table: DataFrame, threshold: float | Column | None = None) -> DataFrame:
    """From a stored distance table: ``total_ha`` of all events (``cum`` covers only those in its bins, ``perc`` relates it to
    all) and ``perc`` at the threshold, to two digits; NULL where the table cannot tell."""
    perc, cum = F.max_by("perc", "distance"), F.max_by("cum", "distance")
    at = F.max(F.when(F.col("distance") == threshold, F.col("perc"))) if threshold is not None else F.lit(None).cast("double")
    return table.agg(F.when(perc > 0, 100.0 * cum / perc).alias("total_ha"), F.bround(at, 2).alias("perc"))


def border_faults(polygons: DataFrame) -> DataFrame:
    """One row of counts of what makes borders unusable: ``polygons (kind, rings)``."""
    usable = F.coalesce(F.size("rings") > 0, F.lit(False))
    return polygons.agg(
        (F.count("*") == 0).cast("int").alias("no_features"),
        F.count_if(~usable).alias("empty"),
        F.count_if(usable & ~F.coalesce(F.col("kind").isin(*POLYGONS), F.lit(False))).alias("not_polygons"),
    )


def require_borders(polygons: DataFrame) -> None:
    r = border_faults(polygons).first()
    if r["no_features"]:
        raise ValueError("the borders hold no features")
    if r["empty"]:
        raise ValueError(f"{r['empty']} features of the borders have no geometry")
    if r["not_polygons"]:
        raise ValueError(f"{r['not_polygons']} features of the borders are no polygons")


def stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row: two exact quantiles of the finite values."""
    return quantiles(df.filter(finite(value)), value, [low, high]).toDF("low", "high")
