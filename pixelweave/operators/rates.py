"""Rate tables, coarse-cell tallies, accuracy indices and allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.scalars import annual_rate, model_rate
from pixelweave.operators.layers import event, population
from pixelweave.operators.ranks import quantiles
from pixelweave.sources.shared import small, written


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """``df`` with totals of all its rows: one row of aggregates, broadcast (its size is fixed)."""
    one = df.agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(F.broadcast(one))


def category_counts(px: DataFrame, cat: str = "risk", forest: str = "forest_t1", loss: str = "loss") -> DataFrame:
    pop, ev = population(F.col(forest), F.col(loss)), event(F.col(loss))
    return (
        px.filter(F.col(cat) > 0)
        .groupBy(F.col(cat).cast("long").alias("cat"))
        .agg(F.count_if(pop).alias("nfor"), F.count_if(ev).alias("ndefor"))
    )


def defrate_per_cat(
    px: DataFrame,
    years: float,
    pixel_area: float,
    cat: str = "risk",
    forest: str = "forest_t1",
    loss: str = "loss",
    dense: int | None = None,
    density_from: str = "rate_abs"
) -> DataFrame:
    """Observed, modelled and adjusted rate of each category; ``dense`` adds the categories without pixels."""
    t = category_counts(px, cat, forest, loss)
    if dense:
        t = px.sparkSession.range(1, dense + 1).select(F.col("id").alias("cat")).join(t, "cat", "left").fillna(0, ["nfor", "ndefor"])
    t = t.withColumn("rate_obs", annual_rate(F.col("ndefor"), F.col("nfor"), years)).withColumn("rate_mod", model_rate(F.col("cat")))
    t = with_totals(t, _nd=F.sum("ndefor"), _exp=F.sum(F.col("nfor") * F.col("rate_mod")))
    t = t.withColumn("rate_abs", F.col("rate_mod") * F.try_divide(F.col("_nd").cast("double"), F.col("_exp")))
    return _rate_columns(t, years, pixel_area, density_from)


def defrate_per_class(
    px: DataFrame,
    years: float,
    pixel_area: float,
    cat: str,
    forest: str = "forest_t1",
    loss: str = "loss",
    model: DataFrame | None = None
) -> DataFrame:
    """As per category, of vulnerability classes with forest; rates come from the table ``model (cat, rate_mod)`` if given."""
    t = category_counts(px, cat, forest, loss).filter("nfor > 0").withColumn("rate_obs", annual_rate(F.col("ndefor"), F.col("nfor"), years))
    if model is None:
        t = t.withColumn("rate_mod", F.col("ndefor") / F.col("nfor"))
    else:
        t = t.join(model.select("cat", "rate_mod"), "cat", "left")
    t = with_totals(t, _nd=F.sum("ndefor"), _exp=F.sum(F.col("nfor") * F.col("rate_mod")))
    t = t.withColumn("rate_abs", F.col("rate_mod") * F.try_divide(F.col("_nd").cast("double"), F.col("_exp")))
    return _rate_columns(t, years, pixel_area, "rate_abs")


def _rate_columns(t: DataFrame, years: float, pixel_area: float, density_from: str) -> DataFrame:
    return t.select(
        "cat", "nfor", "ndefor", F.lit(float(years)).alias("time_interval"), "rate_obs", "rate_mod", "rate_abs",
        F.lit(pixel_area).alias("pixel_area"), (F.col(density_from) * pixel_area / years).alias("defor_dens"),
    )


def period_layers(px: DataFrame, fcc: str, period: str) -> DataFrame:
    """Population and event columns of a three-date stack for a period."""
    f = F.col(fcc)
    pop, ev = {"calibration": (f > 0, f == 1), "validation": (f > 1, f == 2), "historical": (f > 0, f.isin(1, 2)), "forecast": (f > 0, f.isin(1, 2))}[period]
    return px.withColumn("_forest", pop.cast("int")).withColumn("_loss", ev.cast("int"))


def distance_table(px: DataFrame, dist: str, loss: str, step: float, last: float, pixel_area: float) -> DataFrame:
    """Events by right-closed distance bin, with area, running area and percentage of all events."""
    bins = int(last // step)
    d = F.col(dist)
    hits = px.filter(F.col(loss) == 1).select(F.when((d > 0) & (d <= bins * step), F.ceil(d / step).cast("long")).alias("bin"))
    counts = hits.groupBy("bin").agg(F.count("*").alias("npix"))
    total = hits.agg(F.count("*").alias("total"))
    t = px.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin")).join(counts, "bin", "left").fillna(0, ["npix"])
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row a bin, whatever the number of pixels
    t = t.select(
        (F.col("bin") * step).alias("distance"),
        "npix",
        (F.col("npix") * pixel_area).alias("area"),
        (F.sum("npix").over(run) * pixel_area).alias("cum")
    )
    return t.join(F.broadcast(total)).select("distance", "npix", "area", "cum", F.try_divide(100.0 * F.col("cum"), F.col("total") * pixel_area).alias("perc"))


def distance_threshold(table: DataFrame, percent: float = 99.5) -> DataFrame:
    """One row: the first distance with more than ``percent`` of the events, and its percentage to two digits; NULL without one."""
    return table.filter(F.col("perc") > percent).agg(F.min("distance").alias("dist_thresh"), F.round(F.min_by("perc", "distance"), 2).alias("perc"))


def require_threshold(table: DataFrame, percent: float = 99.5) -> tuple[float, float]:
    """(distance, percentage) of ``distance_threshold``; ValueError if no distance reaches the percentage."""
    r = distance_threshold(table, percent).first()
    if r["dist_thresh"] is None:
        raise ValueError(f"no distance in the table holds more than {percent} % of the events: take a larger last distance")
    return r["dist_thresh"], r["perc"]


def cell_tally(
    px: DataFrame,
    rates: DataFrame,
    n_cols: int,
    csize: int | Column,
    years: float,
    pixel_area: float,
    cat: str = "risk",
    forest: str = "forest_t1",
    loss: str = "loss",
    by: tuple[str, ...] = ()
) -> DataFrame:
    """Observed and predicted events per coarse cell; cells without forest are dropped. ``csize`` may be a column.

    Pixels become one row a (cell, category) before they meet the rates, so a hot category is not one task."""
    size = csize if isinstance(csize, Column) else F.lit(csize)
    cell = F.floor(F.col("row") / size).cast("long") * F.ceil(F.lit(n_cols) / size).cast("long") + F.floor(F.col("col") / size).cast("long")
    t = px.groupBy(*by, cell.alias("cell"), F.col(cat).cast("long").alias("_of")).agg(
        F.count_if(population(F.col(forest), F.col(loss))).alias("_nfor"),
        F.count_if(event(F.col(loss))).alias("_ndefor"),
        F.count("*").alias("_n"),
    )
    t = t.join(small(rates.select(F.col("cat").cast("long").alias("_of"), "defor_dens")), "_of", "left").groupBy(*by, "cell").agg(
        F.sum("_nfor").alias("nfor_obs"),
        F.sum("_ndefor").alias("ndefor_obs"),
        (F.coalesce(F.sum(F.col("_n") * F.col("defor_dens")), F.lit(0.0)) * years).alias("ndefor_pred_ha"),
    )
    return with_hectares(t, pixel_area).select(*by, "cell", "nfor_obs", "ndefor_obs", "nfor_obs_ha", "ndefor_obs_ha", "ndefor_pred_ha")


def with_hectares(cells: DataFrame, pixel_area: float | Column) -> DataFrame:
    area = pixel_area if isinstance(pixel_area, Column) else F.lit(pixel_area)
    observed = {f"{n}_ha": F.col(n) * area for n in ("nfor_obs", "ndefor_obs")}
    return cells.filter("nfor_obs > 0").withColumns(observed)


def accuracy(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Errors over the cells of each ``by``. The median is dealt out by ranges, so the cells of a map need not fit a task."""
    w, e = F.col("nfor_obs_ha"), F.col("_e")
    cells = written(cells.select(*by, "nfor_obs_ha", "ndefor_obs_ha", "ndefor_pred_ha", (F.col("ndefor_pred_ha") - F.col("ndefor_obs_ha")).alias("_e")))
    out = cells.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.sqrt(F.sum(w * e * e) / F.sum(w)).alias("wRMSE"),
        F.pow(F.corr("ndefor_pred_ha", "ndefor_obs_ha"), F.lit(2)).alias("R2"),
        F.count("*").alias("ncell"),
    )
    middle = quantiles(cells.withColumn("_e", F.abs("_e")), "_e", [0.5], by).withColumnRenamed("_q0", "MedAE")
    out = out.join(middle, list(by), "left") if by else out.join(F.broadcast(middle))  # without by one row each
    return out.select(*by, "RMSE", "wRMSE", "MedAE", "R2", "ncell")


def forecast_rates(rates: DataFrame, juris_ha: float, years: int) -> DataFrame:
    """The rate table with the rates and densities that an allocation of ``juris_ha`` hectares over ``years`` gives its
    categories."""
    t = with_totals(rates, _exp=F.sum(F.col("nfor") * F.col("rate_mod")))
    rate = F.col("rate_mod") * F.lit(juris_ha) / (F.col("pixel_area") * F.col("_exp"))
    return t.select("cat", "nfor", "rate_mod", "pixel_area", rate.alias("rate_abs"), (rate * F.col("pixel_area") / years).alias("defor_dens"))


def allocation(counts: DataFrame, rates: DataFrame, juris_ha: float, years: int, pixel_area: float) -> DataFrame:
    """Two rows, annual and entire period: ``counts (cat, npix)`` of the project times the adjusted densities."""
    t = with_totals(rates, _exp=F.sum(F.col("nfor") * F.col("rate_mod")))
    dens = t.select("cat", (F.col("rate_mod") * (F.lit(juris_ha) / (F.lit(pixel_area) * F.col("_exp"))) * pixel_area / years).alias("dens"))
    annual = counts.join(dens, "cat", "left").agg(F.sum(F.col("npix") * F.coalesce("dens", F.lit(0.0))).alias("ha"))
    rows = F.array(
        F.struct(F.lit("annual").alias("period"), F.lit(1).alias("length"), F.col("ha").alias("deforestation")),
        F.struct(F.lit("entire").alias("period"), F.lit(years).alias("length"), (F.col("ha") * years).alias("deforestation"))
    )
    return annual.select(F.explode(rows).alias("r")).select("r.*")


REQUIRED = ("cat", "nfor", "rate_mod", "pixel_area")


def rate_table_faults(rates: DataFrame) -> DataFrame:
    """One row of violation counts of a rate table's contract, in the order in which they are reported."""
    missing = [c for c in REQUIRED if c not in rates.columns]
    t = rates.select(*rates.columns, *[F.lit(None).cast("double").alias(c) for c in missing])
    cat = F.col("cat").cast("double")
    odd = lambda c: F.coalesce(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), F.lit(True))
    three = REQUIRED[1:]
    total = F.coalesce(F.sum(F.when(~odd("nfor") & ~odd("rate_mod"), F.col("nfor").cast("double") * F.col("rate_mod"))), F.lit(0.0))
    return t.agg(
        F.lit(len(missing)).alias("missing_columns"),
        F.count_if(F.coalesce(cat != F.floor(cat), F.lit(True))).alias("not_whole"),
        F.count_if(cat <= 0).alias("not_positive"),
        (F.count("cat") - F.count_distinct("cat")).alias("repeated"),
        sum((F.count_if(odd(c)) for c in three[1:]), F.count_if(odd(three[0]))).alias("not_finite"),
        sum((F.count_if(F.col(c) < 0) for c in three[1:]), F.count_if(F.col(three[0]) < 0)).alias("negative"),
        (F.count_distinct("pixel_area") != 1).cast("int").alias("areas_differ"),
        F.coalesce((F.min("pixel_area") <= 0).cast("int"), F.lit(0)).alias("no_area"),
        (total <= 0).cast("int").alias("no_risk"),
    )


def require_rate_table(rates: DataFrame) -> None:
    """ValueError that names the first fault of a rate table."""
    r = rate_table_faults(rates).first()
    for name, n in r.asDict().items():
        if n:
            raise ValueError(f"rate table: {name} ({n})")
