"""Evaluation of many maps, each against a truth of its own, at many cell sizes.

Pixels are read once and become one row a (map, category, base cell); the side of a base cell divides all cell sizes. The
rate tables, and the cells of every size, follow from these rows, so neither maps of one stack nor cell sizes multiply what is
shuffled of the pixels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.scalars import model_rate
from pixelweave.operators.layers import event, population
from pixelweave.operators.rates import accuracy, with_hectares
from pixelweave.sources.shared import discard, small, written


@dataclass(frozen=True)
class Run:
    """A truth and the maps that are held against it.

    ``px`` has ``row, col`` and the truth's forest and loss. A map is a column of categories of ``px``, or a layer
    ``(row, col, value)`` of its own on the same grid, whose pixels meet those of ``px``. ``models`` may name a map's model.
    """

    px: DataFrame
    maps: dict[str, Column | DataFrame]
    n_cols: int
    years: float
    pixel_area: float
    period: str = ""
    truth: str = ""
    forest: str = "forest_t1"
    loss: str = "loss"
    models: dict[str, str] = field(default_factory=dict)

    def tally(self, base: int, first: int) -> DataFrame:
        """``(_map, _cat, _r, _c, _n, _nfor, _ndefor)``; maps are numbered from ``first``."""
        pop, ev = population(F.col(self.forest), F.col(self.loss)), event(F.col(self.loss))
        own = [F.floor(F.col("row") / base).alias("_r"), F.floor(F.col("col") / base).alias("_c"), pop.alias("_pop"), ev.alias("_ev")]
        parts = []
        columns = [(i, c) for i, c in enumerate(self.maps.values(), first) if isinstance(c, Column)]
        if columns:
            every = F.array(*[F.struct(F.lit(i).alias("_map"), c.cast("long").alias("_cat")) for i, c in columns])
            parts.append(self.px.select(*own, F.explode(every).alias("_m")).select("_m._map", "_m._cat", "_r", "_c", "_pop", "_ev"))
        for i, layer in enumerate(self.maps.values(), first):
            if not isinstance(layer, Column):
                met = self.px.select("row", "col", self.forest, self.loss).join(layer.select("row", "col", F.col("value").cast("long").alias("_cat")), ["row", "col"])
                parts.append(met.select(F.lit(i).alias("_map"), "_cat", *own))
        t = reduce(DataFrame.union, parts).groupBy("_map", "_cat", "_r", "_c")
        return t.agg(F.count("*").alias("_n"), F.count_if("_pop").alias("_nfor"), F.count_if("_ev").alias("_ndefor"))


def evaluate(runs: Sequence[Run], csizes: Sequence[int]) -> DataFrame:
    """A row a (map, cell size): ``prediction, model, period, truth, csize, ncell, MedAE, R2, RMSE, wRMSE``."""
    base, at, parts, known = math.gcd(*csizes), 0, [], []
    for run in runs:
        parts.append(run.tally(base, at))
        known += [(i, n, run.models.get(n, n), run.period, run.truth, run.n_cols, float(run.years), run.pixel_area) for i, n in enumerate(run.maps, at)]
        at += len(run.maps)
    spark = runs[0].px.sparkSession
    maps = spark.createDataFrame(known, "_map int, prediction string, model string, period string, truth string, _wide int, _years double, _area double")
    maps = F.broadcast(maps)  # a row a map of the call
    t = written(reduce(DataFrame.union, parts))
    rates = t.filter("_cat > 0").groupBy("_map", "_cat").agg(F.sum("_nfor").alias("_nfor"), F.sum("_ndefor").alias("_ndefor")).withColumn("_rate", model_rate(F.col("_cat")))
    totals = rates.groupBy("_map").agg(F.sum("_ndefor").alias("_nd"), F.sum(F.col("_nfor") * F.col("_rate")).alias("_exp")).join(maps, "_map")
    dens = F.col("_rate") * F.try_divide(F.col("_nd").cast("double"), F.col("_exp")) * F.col("_area") / F.col("_years")
    rates = rates.select("_map", "_cat", "_rate").join(totals, "_map").select("_map", "_cat", dens.alias("_dens"))
    cells = t.join(small(rates), ["_map", "_cat"], "left").groupBy("_map", "_r", "_c").agg(
        F.sum("_nfor").alias("_nfor"), F.sum("_ndefor").alias("_ndefor"), F.coalesce(F.sum(F.col("_n") * F.col("_dens")), F.lit(0.0)).alias("_pred")
    )
    cells = cells.withColumn("csize", F.explode(F.array(*map(F.lit, csizes)))).join(maps, "_map")
    line = lambda c: F.floor(F.col(c) * base / F.col("csize")).cast("long")
    cell = line("_r") * F.ceil(F.col("_wide") / F.col("csize")).cast("long") + line("_c")
    cells = cells.groupBy("_map", "csize", cell.alias("cell")).agg(
        F.sum("_nfor").alias("nfor_obs"), F.sum("_ndefor").alias("ndefor_obs"), F.sum(F.col("_pred") * F.col("_years")).alias("ndefor_pred_ha"), F.max("_area").alias("_area")
    )
    out = accuracy(with_hectares(cells, F.col("_area")), ("_map", "csize")).join(maps, "_map")
    out = written(out.select("prediction", "model", "period", "truth", "csize", "ncell", "MedAE", "R2", "RMSE", "wRMSE"))
    discard(t)
    return out


def evaluated(px: DataFrame, maps: dict[str, Column], csizes: list[int], n_cols: int, years: float, pixel_area: float, forest: str = "forest_t1", loss: str = "loss") -> DataFrame:
    """``prediction, csize`` and the indices of maps that are columns of one stack."""
    out = evaluate([Run(px, dict(maps), n_cols, years, pixel_area, forest=forest, loss=loss)], csizes)
    return out.select("prediction", "csize", "RMSE", "wRMSE", "MedAE", "R2", "ncell")
