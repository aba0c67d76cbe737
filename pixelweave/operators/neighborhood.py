"""Moving windows, slopes and coarse cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.scalars import risk_code

TILE = 512


def halo_tiles(
    px: DataFrame,
    names: list[str],
    half: int,
    fn: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]],
    schema: str,
    tile: int = TILE
) -> DataFrame:
    """``fn`` over tile x tile squares of pixels and ``half`` pixels around each: ``row, col`` and what ``fn`` returns.

    ``fn(present, layers)`` gets arrays of (tile + 2 half)² places, NaN where a layer is NULL or there is no pixel, and
    returns arrays of that shape; values at the pixels of the square are kept. Only pixels near a border are copied: one
    shuffle of little more than the table, whatever the size of the window.
    """
    at = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / tile), F.floor((F.col(c) + half) / tile)))
    base = px.select("row", "col", *[F.col(n).cast("double").alias(n) for n in names])
    spread = base.select("*", at("row").alias("_tr")).select("*", at("col").alias("_tc"))
    wide = tile + 2 * half

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["_tr"].iloc[0]) * tile, int(pdf["_tc"].iloc[0]) * tile
        r, c = pdf["row"].to_numpy() - top + half, pdf["col"].to_numpy() - left + half
        present = np.zeros((wide, wide), bool)
        present[r, c] = True
        layers = {}
        for n in names:
            layers[n] = np.full((wide, wide), np.nan)
            layers[n][r, c] = pdf[n].to_numpy()
        own = (r >= half) & (r < half + tile) & (c >= half) & (c < half + tile)
        out = {k: v[r[own], c[own]] for k, v in fn(present, layers).items()}
        return pd.DataFrame({"row": pdf["row"][own].to_numpy(), "col": pdf["col"][own].to_numpy(), **out})

    return spread.groupBy("_tr", "_tc").applyInPandas(run, f"row int, col int, {schema}")


def _box(a: np.ndarray, half: int) -> np.ndarray:
    """Sums over the (2 half + 1)² box of each place; places beyond the array count as zero."""
    size = 2 * half + 1
    total = np.pad(a, ((half + 1, half), (half + 1, half))).cumsum(0).cumsum(1)
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def box_sums(px: DataFrame, cols: list[str], half: int) -> DataFrame:
    """Sums of ``cols`` (long) over the (2 half + 1)² box of each pixel of ``px``; NULL and missing pixels count as zero."""

    def sums(_: np.ndarray, layers: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {c: _box(np.nan_to_num(layers[c]).astype(np.int64), half) for c in cols}

    return halo_tiles(px, cols, half, sums, ", ".join(f"{c} long" for c in cols))


def local_rates(px: DataFrame, forest: Column, loss: Column, sizes: Sequence[int], years: float, zero_code: int = 2) -> DataFrame:
    """As ``local_rate``, a column ``ldefrate_<size>`` a window: one pass serves all sizes, with the border of the largest."""
    if not sizes or any(s % 2 == 0 or s < 1 for s in sizes):
        raise ValueError("the window size must be odd")
    marked = px.select("row", "col", F.coalesce(forest, F.lit(False)).cast("long").alias("n"), F.coalesce(loss, F.lit(False)).cast("long").alias("d"))

    def sums(_: np.ndarray, layers: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n, d = (np.nan_to_num(layers[k]).astype(np.int64) for k in ("n", "d"))
        return {"own": n} | {f"{k}{s}": _box(v, s // 2) for s in sizes for k, v in (("n", n), ("d", d))}

    t = halo_tiles(marked, ["n", "d"], max(sizes) // 2, sums, "own long, " + ", ".join(f"n{s} long, d{s} long" for s in sizes))

    def coded(s: int) -> Column:
        theta = 1 - F.pow(1 - F.try_divide(F.col(f"d{s}"), F.col(f"n{s}")), F.lit(1.0 / years))
        return F.when(F.col("own") == 0, 0).when(F.col(f"d{s}") == 0, zero_code).otherwise(risk_code(theta, 2)).alias(f"ldefrate_{s}")

    return t.select("row", "col", *[coded(s) for s in sizes])


def local_rate(px: DataFrame, forest: Column, loss: Column, size: int, years: float, zero_code: int = 2) -> DataFrame:
    """Rate of the window around each pixel: 2..65535 at population pixels (``zero_code`` where it is zero), 0 elsewhere."""
    return local_rates(px, forest, loss, [size], years, zero_code).withColumnRenamed(f"ldefrate_{size}", "ldefrate")


def slope(px: DataFrame, value: str, res: float) -> DataFrame:
    """Horn gradient in degrees of pixels with all eight neighbours."""

    def horn(_: np.ndarray, layers: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        z = layers[value]
        at = lambda r, c: np.roll(z, (-r, -c), (0, 1))
        x = sum(c * (2 - abs(r)) * at(r, c) for r in (-1, 0, 1) for c in (-1, 1))
        y = sum(r * (2 - abs(c)) * at(r, c) for r in (-1, 1) for c in (-1, 0, 1))
        return {"slope": np.degrees(np.arctan(np.sqrt(x * x + y * y) / (8 * res))) + 0 * z}

    out = halo_tiles(px, [value], 1, horn, "slope double")
    return out.filter(F.col("slope").isNotNull() & ~F.isnan("slope"))


def cells_across(csize: int, n_cols: int) -> int:
    return -(-n_cols // csize)


def cell_index(row: Column, col: Column, csize: int, n_cols: int) -> Column:
    return F.floor(row / csize).cast("long") * cells_across(csize, n_cols) + F.floor(col / csize).cast("long")


def cell_index_km(flat_id: Column, csize_km: float, res: float, n_cols: int) -> Column:
    """Coarse cell of csize_km kilometres that holds the centre of the pixel ``flat_id`` (row * n_cols + col)."""
    side = csize_km * 1000.0
    wide = int(np.ceil(n_cols * res / side))
    centre = lambda i: F.floor((i + 0.5) * res / side).cast("long")
    return centre(F.floor(flat_id / n_cols)) * wide + centre(flat_id % n_cols)


def cell_neighbors(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """``cells (cell)`` of an n_rows x n_cols cell grid: queen neighbours inside the grid."""
    step = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    t = cells.select("cell", F.explode(step).alias("s")).select(
        "cell",
        (F.floor(F.col("cell") / n_cols) + F.col("s.dr")).alias("r"),
        (F.col("cell") % n_cols + F.col("s.dc")).alias("c")
    )
    return t.filter(F.col("r").between(0, n_rows - 1) & F.col("c").between(0, n_cols - 1)).select(
        "cell",
        (F.col("r") * n_cols + F.col("c")).cast("long").alias("neighbor")
    )
