"""Resampling onto another grid, by tiles of the target."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 512


def _reached(at: str, factor: float, shift: float, bilinear: bool) -> tuple[Column, Column]:
    """First and last target line whose value takes in the source line ``at``, from a little before to a little after."""
    before, after = (0.5, 1.5) if bilinear else (0.0, 1.0)
    line = lambda edge: (F.col(at) + edge - shift) * factor - 0.5
    return F.ceil(line(-before) - 1e-6), F.floor(line(after) + 1e-6)


def regrid(px: DataFrame, target: DataFrame, value: str, factor: float, bilinear: bool = False, shift: tuple[float, float] = (0.0, 0.0), tile: int = TILE) -> DataFrame:
    """``target (row, col)`` pixels whose size is 1/factor of the source's, valued from ``px``.

    ``shift`` is the place (row, col) of the target's corner on the source grid, in source pixels. Nearest takes the pixel
    that holds the centre, NULL outside the source; bilinear weighs the four centres around it, without the NULL ones.

    Source pixels go to the target tiles that they reach: those near a border to several, coarse ones to all that they cover,
    those that no target pixel takes in to none. A target pixel is one row, and each side is shuffled once.
    """
    lines = []
    for k, axis in enumerate(("_sr", "_sc")):
        first, last = _reached(axis, factor, shift[k], bilinear)
        lines.append((first, last, F.explode(F.sequence(F.floor(first / tile), F.floor(last / tile)))))
    source = px.select(F.col("row").alias("_sr"), F.col("col").alias("_sc"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    source = source.filter((lines[0][0] <= lines[0][1]) & (lines[1][0] <= lines[1][1]))
    source = source.select("*", lines[0][2].alias("_tr")).select("*", lines[1][2].alias("_tc"))
    wanted = target.select(F.floor(F.col("row") / tile).alias("_tr"), F.floor(F.col("col") / tile).alias("_tc"), F.col("row").alias("_row"), F.col("col").alias("_col"))

    def valued(_: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        row, col = left.column("_row").to_numpy(), left.column("_col").to_numpy()
        y, x = (row + 0.5) / factor + shift[0], (col + 0.5) / factor + shift[1]
        sr, sc, v = (right.column(c).to_numpy() for c in ("_sr", "_sc", "_v"))
        if not len(sr):
            return pa.table([pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.nulls(len(row), pa.float64())], ["row", "col", value])
        top, side = int(sr.min()), int(sc.min())
        wide = int(sc.max()) - side + 1
        place = (sr - top).astype(np.int64) * wide + (sc - side)
        order = np.argsort(place)
        place, v = place[order], v[order]

        def at(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which places have a value, and the value (0 without)."""
            want = (r.astype(np.int64) - top) * wide + (c.astype(np.int64) - side)
            i = np.minimum(np.searchsorted(place, want), len(place) - 1)
            found = (place[i] == want) & (c >= side) & (c < side + wide)
            return found, np.where(found, v[i], 0.0)

        if bilinear:
            r0, c0 = np.floor(y - 0.5), np.floor(x - 0.5)
            fr, fc = (y - 0.5) - r0, (x - 0.5) - c0
            total, known = np.zeros(len(row)), np.zeros(len(row))
            for a in (0, 1):
                for b in (0, 1):
                    w = (fr if a else 1 - fr) * (fc if b else 1 - fc)
                    found, own = at(r0 + a, c0 + b)
                    total += w * own
                    known += w * found
            out, none = total / np.where(known > 0, known, 1.0), known <= 0
        else:
            found, out = at(np.floor(y), np.floor(x))
            none = ~found
        return pa.table([pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(out, pa.float64(), mask=none)], ["row", "col", value])

    keys = ("_tr", "_tc")
    met = wanted.groupBy(*keys).cogroup(source.groupBy(*keys))
    return met.applyInArrow(valued, f"row int, col int, `{value}` double")
