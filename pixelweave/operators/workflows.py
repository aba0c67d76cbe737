"""Whole runs: fitting and applying the window and class models, evaluating, allocating, harmonising, running periods."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.scalars import geometric_edges
from pixelweave.operators import catalog as C
from pixelweave.operators import layers as L
from pixelweave.operators import neighborhood as N
from pixelweave.operators import rates as R
from pixelweave.operators import summaries as S
from pixelweave.operators.geometry import crop

STEP = 30.0


@dataclass(frozen=True)
class WindowModel:
    """Distance beyond which there is no risk, and the windows of the local rates."""

    dist_thresh: float
    perc_thresh: float
    windows: tuple[int, ...]
    years: float


@dataclass(frozen=True)
class ClassModel:
    """Distance beyond which the class is the lowest, and the edges of the distance classes."""

    dist_thresh: float
    perc_thresh: float
    edges: tuple[float, ...]


def _threshold(px: DataFrame, dist: str, loss: str, percent: float, last: float, pixel_area: float) -> tuple[float, float]:
    S.require_binary(px, loss)
    return R.require_threshold(R.distance_table(px, dist, loss, STEP, last, pixel_area), percent)


def window_fit(
    px: DataFrame,
    dist: str,
    loss: str,
    years: float,
    pixel_area: float,
    windows: Sequence[int] = (5, 11, 21),
    percent: float = 99.5,
    last: float = 5000.0
) -> WindowModel:
    """ValueError if the loss layer is no 0/1 layer with a 1, or no distance reaches ``percent``."""
    if not windows or any(w % 2 == 0 or w < 1 for w in windows):
        raise ValueError("windows must be odd sizes")
    return WindowModel(*_threshold(px, dist, loss, percent, last, pixel_area), tuple(windows), float(years))


def local_rates(px: DataFrame, model: WindowModel, window: int, forest: str, loss: str) -> DataFrame:
    """``(row, col, ldefrate)`` of the fitting period; a window that the model was not fitted for raises ValueError."""
    if window not in model.windows:
        raise ValueError(f"window {window} is none of {model.windows}")
    return N.local_rate(px, L.population(F.col(forest), F.col(loss)), L.event(F.col(loss)), window, model.years)


def all_local_rates(px: DataFrame, model: WindowModel, forest: str, loss: str) -> DataFrame:
    """``(row, col, ldefrate_<window>, ...)``: the local rates of all windows of the model, in one pass."""
    return N.local_rates(px, L.population(F.col(forest), F.col(loss)), L.event(F.col(loss)), model.windows, model.years)


def window_apply(
    local: DataFrame,
    px: DataFrame,
    model: WindowModel,
    dist: str,
    forest: str,
    loss: str,
    years: float,
    pixel_area: float,
    zero_cat: int = 1
) -> tuple[DataFrame, DataFrame]:
    """The risk map ``(row, col, risk)`` of a period, and its rate table. Pixels without a local rate (0) are nodata."""
    t = local.filter("ldefrate > 0").join(px.select("row", "col", dist, forest, loss), ["row", "col"])
    t = t.withColumn("risk", L.zero_beyond(F.col("ldefrate"), F.col(dist), model.dist_thresh, zero_cat))
    return t.select("row", "col", "risk"), R.defrate_per_cat(t, years, pixel_area, "risk", forest, loss)


def class_fit(px: DataFrame, dist: str, loss: str, res: float, pixel_area: float, percent: float = 99.5, last: float = 5000.0, classes: int = 29) -> ClassModel:
    reach, perc = _threshold(px, dist, loss, percent, last, pixel_area)
    return ClassModel(reach, perc, tuple(geometric_edges(res, reach, classes)))


def class_apply(
    px: DataFrame,
    model: ClassModel,
    dist: str,
    forest: str,
    loss: str,
    subj: str,
    years: float,
    pixel_area: float,
    rates: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The class map ``(row, col, vuln)`` of a period, and its rate table. ``rates``, the table of the period that the model
    was fitted on, gives the relative rates (NULL for a class that it lacks); without it they are the period's own."""
    S.require_binary(px, loss)
    t = px.withColumn("vuln", L.vulnerability(F.col(dist), F.col(forest), F.col(subj), list(model.edges)))
    return t.select("row", "col", "vuln"), R.defrate_per_class(t, years, pixel_area, "vuln", forest, loss, rates)


def allocate(
    px: DataFrame,
    rates: DataFrame,
    borders: DataFrame,
    juris_ha: float,
    years: int,
    grid,
    cat: str = "risk",
    mask: Column | None = None
) -> DataFrame:
    """Annual and entire hectares of a project: the rate table and the borders are checked, the map is cut to the borders
    (every touched pixel), its pixels are counted per category and take the adjusted densities. ``grid`` places the map;
    ``borders (feature_id, kind, rings)``. ValueError if the table is at fault, belongs to other pixels, or knows none of
    the project's categories (99.9 % of its pixels), and if no pixel is left."""
    R.require_rate_table(rates)
    S.require_borders(borders)
    area = rates.select("pixel_area").first()[0]
    if abs(area - grid.pixel_area_ha()) > 1e-6 * grid.pixel_area_ha():
        raise ValueError(f"the table has pixels of {area} ha, the map of {grid.pixel_area_ha()} ha")
    inside = crop(px, borders, grid.n_rows, grid.x0, grid.y0, grid.res_x, grid.n_cols)
    counts = S.project_counts(inside, cat, mask if mask is not None else F.lit(1))
    share = counts.join(rates.select("cat", F.lit(1).alias("_known")), "cat", "left").agg(
        F.sum("npix"),
        F.sum(F.when(F.col("_known").isNull(), F.col("npix")).otherwise(0))
    ).first()
    if not share[0]:
        raise ValueError("no pixel of the map lies in the borders")
    if share[1] > 0.999 * share[0]:
        raise ValueError("the rate table knows none of the project's categories")
    return R.allocation(counts, rates, juris_ha, years, area)


def density_map(px: DataFrame, rates: DataFrame, juris_ha: float, years: int, cat: str = "risk") -> DataFrame:
    """``(row, col, dens)``: hectares a year that the allocation gives each pixel, 0 for categories that the table lacks."""
    t = R.with_totals(rates, _exp=F.sum(F.col("nfor") * F.col("rate_mod")))
    dens = F.col("rate_mod") * F.lit(juris_ha) / F.col("_exp") / years  # pixel areas cancel out
    return S.densities(px, t.select("cat", dens.alias("defor_dens")), cat)


def dependency_levels(keys: Sequence[str], needs: dict[str, Sequence[str]]) -> list[list[str]]:
    """``keys`` in levels, each in name order: a key comes after all that it needs, directly or through keys that are not in
    ``keys``. A cycle raises ValueError."""
    level: dict[str, int] = {}
    for start in sorted({*keys, *needs}):
        path, stack = [], [(start, iter(needs.get(start, ())))] if start not in level else []
        path += [start] if stack else []
        while stack:
            key, rest = stack[-1]
            for other in rest:
                if other in path:
                    raise ValueError("layers depend on each other in a circle: " + " > ".join([*path[path.index(other) :], other]))
                if other not in level:
                    stack.append((other, iter(needs.get(other, ()))))
                    path.append(other)
                    break
            else:
                level[key] = max((level[n] + 1 for n in needs.get(key, ())), default=0)
                stack.pop()
                path.pop()
    out: dict[int, list[str]] = {}
    for key in sorted(set(keys)):
        out.setdefault(level[key], []).append(key)
    return [out[i] for i in sorted(out)]


def outdated(stale: set[str], needs: dict[str, Sequence[str]]) -> set[str]:
    """``stale`` and every layer that needs one of them, directly or not."""
    out = set(stale)
    while more := {key for key, other in needs.items() if key not in out and out.intersection(other)}:
        out |= more
    return out


def harmonise(
    raw: DataFrame,
    processed: DataFrame,
    signature: str,
    run: Callable[[str], tuple[DataFrame, str]],
    sink: Callable[[str, DataFrame], None],
    order: Sequence[str] = (),
    needs: dict[str, Sequence[str]] | None = None,
) -> list[str]:
    """Redo every layer that is not current: ``run(key)`` gives its pixels and path, ``sink`` writes them.

    ``needs`` names the layers that a layer is made from. A layer is redone after all that it needs, and whenever one of them
    is redone; a circle raises ValueError before anything is written. Within a level keys go by ``order``, then by name.
    Returns the keys done, in order. The catalog has a row a layer, so its keys may be listed.
    """
    needs = needs or {}
    rows = C.harmonisation(raw, processed, signature).select("key", "status").collect()
    known = {r["key"] for r in rows}
    todo = outdated({r["key"] for r in rows if r["status"] != "current"}, needs) & known
    place = lambda k: (order.index(k) if k in order else len(order), k)
    done = []
    for level in dependency_levels(sorted(todo), needs):
        for key in sorted(level, key=place):
            px, path = run(key)
            sink(path, px)
            done.append(key)
    return done


def threshold_statistics(px: DataFrame, dist: str, loss: str, pixel_area: float, percent: float = 99.5, last: float = 5000.0, classes: int | None = None) -> DataFrame:
    """One row of a window or class fit: its threshold, the share of events within it, the events' hectares, and of a class
    fit the number of classes."""
    at = R.distance_threshold(R.distance_table(px, dist, loss, STEP, last, pixel_area), percent)
    total = px.agg((F.count_if(F.col(loss) == 1) * pixel_area).alias("tot_defor_ha"))
    out = at.join(F.broadcast(total)).select("dist_thresh", F.col("perc").alias("perc_thresh"), "tot_defor_ha")  # one row each
    return out if classes is None else out.withColumn("n_classes", F.lit(classes))


def change_layer(catalog: DataFrame, op: str, start: str, end: str, read: Callable[[str], DataFrame]) -> tuple[str, DataFrame]:
    """Name and pixels ``(row, col, value)`` of the change between two layers of the catalog; one that exists is read."""
    entry = C.change_entry(catalog, op, start, end)
    if entry["existing"]:
        return entry["name"], read(entry["existing"])
    a, b = (read(p).select("row", "col", F.col("value").alias(n)) for p, n in zip(entry["sources"], "ab", strict=True))
    both = a.join(b, ["row", "col"])
    return entry["name"], both.select("row", "col", L.change(F.col("a"), F.col("b"), op).alias("value"))


def period_rates(px: DataFrame, fcc: str, cat: str, interval: dict[str, float], pixel_area: float) -> DataFrame:
    """Rate tables of the four periods of a three-date stack, one after another in ``period``: calibration and historical
    have their own rates; validation takes those of the calibration, forecast those of the historical period."""
    out, fitted = None, {}
    for period, trained_on in (("calibration", "calibration"), ("validation", "calibration"), ("historical", "historical"), ("forecast", "historical")):
        model = fitted.get(trained_on) if period != trained_on else None
        t = R.defrate_per_class(R.period_layers(px, fcc, period), interval[period], pixel_area, cat, "_forest", "_loss", model)
        if period == trained_on:
            fitted[period] = t
        t = t.select(F.lit(period).alias("period"), "*")
        out = t if out is None else out.unionByName(t)
    return out
