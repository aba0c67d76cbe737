"""Sampling designs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.grid import GridSpec
from pixelweave.sources.shared import discard, written
from pixelweave.sources.tiled import TiledLayer, key_of, stack_tiles


def ranked(px: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Row-major rank from 0 of each pixel (within ``by``): counts per line, their running total, then ranks in lines."""
    keys = [*by, "row"]
    lines = px.groupBy(*keys).agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*by).orderBy("row") if by else Window.orderBy("row")  # one row a grid line
    lines = lines.select(*keys, (F.sum("_n").over(run) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("col")) - 1
    return px.withColumn("_at", at).join(lines, keys).withColumn("rank", F.col("_before") + F.col("_at")).drop("_at", "_before")


def random_points(px: DataFrame, n: int, seed: int) -> DataFrame:
    """n pixels without replacement, in draw order; all if there are no more than n."""
    total = px.count()
    if n >= total:
        return px.withColumn("draw", F.lit(None).cast("long"))
    ranks = np.random.default_rng(seed).choice(total, n, replace=False)
    drawn = px.sparkSession.createDataFrame([(int(r), i) for i, r in enumerate(ranks)], "rank long, draw long")
    return ranked(px).join(F.broadcast(drawn), "rank").drop("rank")  # n rows, the size asked for


def stratified_points(px: DataFrame, strata: str, wanted: dict[int, int], seed: int) -> DataFrame:
    """wanted[class] pixels of each class, classes in descending order; short classes give all they have."""
    have = {r[0]: r[1] for r in px.groupBy(strata).count().collect()}
    rng, rows = np.random.default_rng(seed), []
    for cls in sorted(have, reverse=True):
        k = min(wanted.get(cls, 0), have[cls])
        rows += [(int(cls), int(r), i) for i, r in enumerate(rng.choice(have[cls], k, replace=False))]
    drawn = px.sparkSession.createDataFrame(rows, f"{strata} int, rank long, draw long")
    return ranked(px, (strata,)).join(F.broadcast(drawn), [strata, "rank"]).drop("rank")


def systematic(px: DataFrame, step_row: int, step_col: int) -> DataFrame:
    return px.filter((F.col("row") % step_row == 0) & (F.col("col") % step_col == 0))


def allocate_equal(counts: DataFrame, n: int) -> DataFrame:
    k = counts.agg(F.count("*").alias("_k"))
    return counts.join(F.broadcast(k)).withColumn("n_alloc", F.least(F.floor(F.lit(n) / F.col("_k")), F.col("n"))).drop("_k")


def allocate_proportional(counts: DataFrame, n: int) -> DataFrame:
    t = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(t)).withColumn(
        "n_alloc",
        F.least(F.bround(F.lit(float(n)) * F.col("n") / F.col("_t"), 0).cast("long"), F.col("n"))
    ).drop("_t")


def adaptive_size(pixels: Column, pixel_area: float) -> Column:
    """1000 samples a million hectares of ``pixels``, rounded half to even, 10 000 to 50 000."""
    wanted = 1000 * (F.lit(pixel_area) * pixels) / 1e6
    return F.when(wanted >= 50_000, 50_000).when(wanted <= 10_000, 10_000).otherwise(F.bround(wanted, 0)).cast("long")


def allocate_each(counts: DataFrame, n: int, pixel_area: float | None = None) -> DataFrame:
    """``n`` samples of every class, or with a pixel area the adaptive number for the area of all classes together; no
    more than a class has."""
    if pixel_area is None:
        return counts.withColumn("n_alloc", F.least(F.lit(n).cast("long"), F.col("n")))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).withColumn("n_alloc", F.least(adaptive_size(F.col("_t"), pixel_area), F.col("n"))).drop("_t")  # one row


ALLOCATIONS = {"equal": allocate_equal, "proportional": allocate_proportional}


def points(
    px: DataFrame,
    value: str,
    grid: GridSpec,
    strategy: str,
    n: int | None = None,
    allocation: str = "equal",
    seed: int = 0,
    spacing: float | None = None,
    adapt: bool = False
) -> DataFrame:
    """``(draw, strata, row, col, x, y)``: pixels with a value, at their centres, by a strategy.

    ``random`` and ``stratified`` number their points in the order of the draw (classes in descending order, events first);
    all pixels are taken, in row order, if there are no more than ``n``. ``systematic`` takes every k-th row and column: by
    ``spacing`` in metres, or so that about ``n`` are left. Only systematic sampling with a spacing may leave out ``n``.
    """
    if n is None and not (strategy == "systematic" and spacing is not None):
        raise ValueError(f"the number of samples is needed for {strategy} sampling")
    valid = px.filter(F.col(value).isNotNull()).select("row", "col", F.col(value).cast("int").alias("strata"))
    if strategy == "random":
        out = random_points(valid, n, seed)
    elif strategy == "stratified":
        counts = valid.groupBy("strata").agg(F.count("*").alias("n"))
        area = grid.pixel_area_ha() if adapt else None
        alloc = allocate_each(counts, n, area) if allocation == "each" else ALLOCATIONS[allocation](counts, n)
        out = stratified_points(valid, "strata", {r["strata"]: r["n_alloc"] for r in alloc.collect()}, seed)
    elif strategy == "systematic":
        if spacing is not None:
            if spacing <= 0:
                raise ValueError("the spacing must be positive")
            steps = [max(1, round(spacing / abs(r))) for r in (grid.res_y, grid.res_x)]
        else:
            have = valid.count()
            steps = [1, 1] if n >= have else [max(1, round((have / n) ** 0.5))] * 2
        out = systematic(valid, *steps).withColumn("draw", F.lit(None).cast("long"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    x, y = grid.centre(F.col("row"), F.col("col"))
    return out.select("draw", "strata", "row", "col", x.alias("x"), y.alias("y"))


def in_draw_order(drawn: DataFrame) -> DataFrame:
    """Events first, each class in the order it was drawn; pixels that were not drawn in row order."""
    return drawn.orderBy(F.desc("strata"), F.asc_nulls_last("draw"), "row", "col")


def sampled_classes(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy("strata").agg(F.count("*").alias("n"))


def around(px: DataFrame, rows: str, cols: str, places: DataFrame) -> DataFrame:
    """``px`` between the first and the last row and column of ``places (row, col)``: two ranges that reach the scan."""
    r0, r1, c0, c1 = places.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if r0 is None:
        return px.limit(0)
    return px.filter(F.col(rows).between(r0, r1) & F.col(cols).between(c0, c1))


def extract(points: DataFrame, layers: DataFrame, names: list[str], width: int) -> DataFrame:
    """``points (row, col)`` with the layers' values where all are known, cell_id and trial. Points are counted: few are
    broadcast, and the layers are filtered by their range and keys where they lie."""
    own = written(points.select("row", "col"))
    t = around(layers.select("row", "col", *names), "row", "col", own).join(few(own), ["row", "col"]).dropna(subset=names)
    return t.select(*names, (F.col("row").cast("long") * width + F.col("col")).alias("cell_id"), F.lit(1).alias("trial"))


FEW_POINTS = 1_000_000


def few(places: DataFrame) -> DataFrame:
    """Marked for broadcast if there are at most ``FEW_POINTS``."""
    return F.broadcast(places) if places.limit(FEW_POINTS + 1).count() <= FEW_POINTS else places


def extract_tiled(points: DataFrame, layers: dict[str, TiledLayer], width: int) -> DataFrame:
    """As ``extract``, from tiled layers: only the row groups with tiles of the points are read."""
    side = next(iter(layers.values())).side
    own = written(points.select("row", "col", key_of(side).alias("_of")))
    tiles = own.select("_of").distinct().limit(MOST_TILES + 1).collect()
    if len(tiles) <= MOST_TILES:
        layers = {n: x.only([t for (t,) in tiles]) for n, x in layers.items()}
    t = stack_tiles(layers).join(few(own.select("row", "col")), ["row", "col"]).dropna(subset=[*layers])
    return t.select(*layers, (F.col("row").cast("long") * width + F.col("col")).alias("cell_id"), F.lit(1).alias("trial"))


MOST_TILES = 10_000  # so many tiles can be named in a filter


def extract_at(points: DataFrame, target: GridSpec, layers: list[tuple[DataFrame, GridSpec, list[str]]]) -> DataFrame:
    """``points (x, y)`` with the values of layers on grids of their own: for each grid the pixel that holds the point.

    A point outside a grid, or without a value in any layer, is left out. ``cell_id`` is the pixel on the target grid. Each
    grid's layer is filtered by the points that are left, in its own rows and columns, and is not shuffled for few points.
    """
    row, col = target.pixel(F.col("x"), F.col("y"))
    t = written(points.select("x", "y", row.alias("_row"), col.alias("_col")).filter("_row IS NOT NULL AND _col IS NOT NULL"))
    every: list[str] = []
    for i, (px, grid, names) in enumerate(layers):
        r, c = grid.pixel(F.col("x"), F.col("y"))
        held = t.withColumn(f"_r{i}", r).withColumn(f"_c{i}", c).filter(F.col(f"_r{i}").isNotNull() & F.col(f"_c{i}").isNotNull())
        own = px.select(F.col("row").alias(f"_r{i}"), F.col("col").alias(f"_c{i}"), *names).dropna(subset=names)
        own = around(own, f"_r{i}", f"_c{i}", held.select(F.col(f"_r{i}").alias("row"), F.col(f"_c{i}").alias("col")))
        t, before = written(own.join(few(held), [f"_r{i}", f"_c{i}"]).drop(f"_r{i}", f"_c{i}")), t
        discard(before)
        every += names
    return t.select(*every, target.flat_id(F.col("_row"), F.col("_col")).alias("cell_id"), F.lit(1).alias("trial"))
