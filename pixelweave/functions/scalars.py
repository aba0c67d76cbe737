"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def risk_code(p: Column, low: int = 1) -> Column:
    """Probability to low..65535; probabilities under 1e-6 count as 1e-6."""
    top, span = F.greatest(p, F.lit(1e-6)) * 1e6 - 1, float(65535 - low)
    return F.floor(top * span / 999999.0 + low).cast("int")


def model_rate(cat: Column) -> Column:
    """Rate that a category stands for; category 1 is rate zero."""
    return F.when(cat == 1, 0.0).otherwise(((cat - 2) * 999999.0 / 65533.0 + 1.0) * 1e-6)


def annual_rate(events: Column, population: Column, years: float) -> Column:
    return 1 - F.pow(1 - F.try_divide(events.cast("double"), population.cast("double")), F.lit(1.0 / years))


def logistic(eta: Column) -> Column:
    """Probability of a linear predictor; one that is not finite raises, NULL stays NULL."""
    finite = ~F.isnan(eta) & (F.abs(eta) < float("inf"))
    return F.when(eta.isNull() | finite, 1 / (1 + F.exp(-eta))).otherwise(F.raise_error(F.lit("the linear predictor is not finite")).cast("double"))


def binary_round(value: Column, digits: int) -> Column:
    """``value`` to ``digits`` decimals by its exact binary value, halves to even: 2.675 is a little below its digits and
    gives 2.67. The product with 10**digits is taken with its rounding error (both factors split in halves of 26 bits), so
    the comparison with a half is exact. Numbers too large to have decimals stay as they are."""
    scale, cut = 10.0**digits, 134217729.0  # 2**27 + 1
    x, p = value, value * scale
    high = x * cut - (x * cut - x)
    low = x - high
    s_high = scale * cut - (scale * cut - scale)
    s_low = scale - s_high
    error = ((high * s_high - p) + high * s_low + low * s_high) + low * s_low
    whole = F.floor(p).cast("double")
    over = (p - whole - 0.5) + error
    up = (over > 0) | ((over == 0) & (whole % 2 != 0))
    return F.when(F.abs(p) < 2.0**52, F.when(up, whole + 1).otherwise(whole) / scale).otherwise(value)


def hectares(pixels: Column, pixel_area: float) -> Column:
    return pixels * F.lit(pixel_area)


def import_code(value: Column, scale: str) -> Column:
    """An outside map in the map contract: probabilities are clipped and coded, risk codes rounded half-even."""
    if scale == "probability":
        return risk_code(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    code = F.least(F.greatest(F.bround(value, 0), F.lit(0.0)), F.lit(65535.0)).cast("int")
    return F.when(code > 0, code)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone, or of the polar UPS grids (5041 north from 84 degrees, 5042 south from -80).

    Zone 32 reaches west between 55 and 64 degrees north, 2 and 6 east (bounds excluded); above 71 degrees north the zones
    of Svalbard widen into parts of zones 32, 34 and 36. At 180 degrees the zone is 61.
    """
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    arctic = lat > 71
    zone = (
        F.when((lat > 55) & (lat < 64) & (lon > 2) & (lon < 6), 32)
        .when(arctic & (lon >= 6) & (lon < 9), 31)
        .when(arctic & (((lon >= 9) & (lon < 12)) | ((lon >= 18) & (lon < 21))), 33)
        .when(arctic & (((lon >= 21) & (lon < 24)) | ((lon >= 30) & (lon < 33))), 35)
        .otherwise(zone)
    )
    return F.when(lat >= 84, 5041).when(lat <= -80, 5042).when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("int")


def geometric_edges(first: float, last: float, classes: int = 29) -> list[float]:
    """classes + 1 edges from first to last in equal ratios."""
    return [first, *[last * (first / last) ** ((classes - i) / classes) for i in range(1, classes + 1)]]


def edge_table(first: Column, last: Column, classes: int = 29) -> Column:
    """``geometric_edges`` of columns: an array of (i, edge)."""
    edge = lambda i: F.when(i == 0, first).otherwise(last * F.pow(first / last, (classes - i) / F.lit(float(classes))))
    return F.transform(F.sequence(F.lit(0), F.lit(classes)), lambda i: F.struct(i.alias("i"), edge(i).alias("edge")))


def odds_ratio(estimate: Column) -> Column:
    out = F.exp(estimate)
    return F.when(out < float("inf"), out)
