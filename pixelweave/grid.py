"""Grids and pixel tables: one row a pixel, keyed by (row, col), one column a layer; nodata is NULL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    crs: str
    x0: float
    y0: float
    res_x: float
    res_y: float
    n_rows: int
    n_cols: int

    def signature(self) -> str:
        return f"{self.crs}|{self.x0!r},{self.y0!r},{self.res_x!r},{self.res_y!r}|{self.n_rows}x{self.n_cols}"

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.lit(self.x0) + (col + 0.5) * self.res_x, F.lit(self.y0) - (row + 0.5) * self.res_y

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) that holds the point; outside the grid both are NULL."""
        row, col = F.floor((F.lit(self.y0) - y) / self.res_y).cast("int"), F.floor((x - self.x0) / self.res_x).cast("int")
        inside = row.between(0, self.n_rows - 1) & col.between(0, self.n_cols - 1)
        return F.when(inside, row), F.when(inside, col)

    def flat_id(self, row: Column, col: Column) -> Column:
        return row.cast("long") * self.n_cols + col

    def pixel_area_ha(self) -> float:
        return abs(self.res_x * self.res_y) / 10_000.0


def stack(*layers: tuple[str, DataFrame]) -> DataFrame:
    """Join layers (row, col, value) of one grid to a wide table."""
    out = None
    for name, df in layers:
        one = df.select("row", "col", F.col("value").alias(name))
        out = one if out is None else out.join(one, ["row", "col"])
    return out
