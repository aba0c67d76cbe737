"""Outside maps: what they are, whether their values fit the scale they are said to have, and the map contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.scalars import import_code
from pixelweave.grid import GridSpec
from pixelweave.operators.resample import regrid
from pixelweave.operators.summaries import value_range

SCALES = ("probability", "risk")
RISK_MAX = 65535
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def inspect(px: DataFrame, value: str, grid: GridSpec | None) -> dict[str, object]:
    """What a layer is: type, grid, number of values and their range. ValueError for a column that is no number, and
    for a layer without a grid."""
    kind = dict(px.dtypes).get(value)
    if kind not in NUMBERS and not str(kind).startswith("decimal"):
        raise ValueError(f"layer {value!r} holds {kind}, not numbers")
    if grid is None:
        raise ValueError(f"layer {value!r} has no grid, so it cannot be placed")
    n, least, most = px.agg(F.count(value), F.min(value), F.max(value)).first()
    return{
        "type": kind,
        "grid": grid.signature(),
        "resolution": (abs(grid.res_x), abs(grid.res_y)),
        "shape": (grid.n_rows, grid.n_cols),
        "count": n,
        "least": least,
        "most": most
    }


def scale_faults(px: DataFrame, value: str, scale: str) -> DataFrame:
    """One row: the range, and the first thing that contradicts the scale (NULL if nothing does)."""
    if scale not in SCALES:
        raise ValueError(f"unknown scale {scale!r}")
    t = value_range(px, value)
    fault = F.when(F.col("least").isNull(), "no values").when(F.col("least") < 0, "negative values").when(F.col("least") == F.col("most"), "constant")
    if scale == "probability":
        fault = fault.when(F.col("most") > 1, "above 1")
    else:
        fault = fault.when(F.col("most") <= 1, "a probability map").when(F.col("most") > RISK_MAX, f"above {RISK_MAX}")
    return t.withColumn("fault", fault)


def require_scale(px: DataFrame, value: str, scale: str) -> None:
    r = scale_faults(px, value, scale).first()
    if r["fault"]:
        raise ValueError(f"the map does not fit the scale {scale!r}: {r['fault']} (values from {r['least']} to {r['most']})")


def imported(
    px: DataFrame,
    value: str,
    scale: str,
    target: DataFrame,
    factor: float = 1.0,
    shift: tuple[float, float] = (0.0, 0.0),
    checked: bool = True
) -> DataFrame:
    """``(row, col, risk)``: an outside map on the pixels of ``target (row, col)``, nearest value, coded 1..65535.

    ``factor`` and ``shift`` place the target on the map as in ``regrid``. Pixels outside the map, without a value or not
    finite are NULL. ``checked`` refuses a map that contradicts the scale.
    """
    if checked:
        require_scale(px, value, scale)
    v = F.col(value).cast("double")
    known = px.select("row", "col", F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("v"))
    return regrid(known, target, "v", factor, shift=shift).select("row", "col", import_code(F.col("v"), scale).alias("risk"))
