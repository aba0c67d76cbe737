"""Pixels that a polygon touches, and polygons that meet other polygons.

Polygons are rows (feature_id, rings array<array<array<double>>>), each ring closed; a point is inside by the even-odd
rule over all rings. NULL and empty rings have no edges: such a polygon touches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.sources.layers import rasterize
from pixelweave.sources.shared import discard, written


def edges(polygons: DataFrame, *also: str) -> DataFrame:
    """``(feature_id, ax, ay, bx, by)`` and the columns ``also``, one row an edge."""
    rings = polygons.select("feature_id", *also, F.explode("rings").alias("ring")).filter(F.size("ring") > 1)
    ends = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))
    e = rings.select("feature_id", *also, F.explode(ends).alias("e"))
    return e.select("feature_id", *also, *[F.col(f"e.{end}")[i].alias(f"{end}{axis}") for end in "ab" for i, axis in enumerate("xy")])


def touched(polygons: DataFrame, n_rows: int, x0: float, y0: float, res: float, n_cols: int) -> DataFrame:
    """``(row, col)`` of all pixels with their centre in a polygon or met by an edge of one."""
    band = lambda y: F.floor((y0 - y) / res)
    e = edges(polygons).withColumn("r0", F.greatest(band(F.greatest("ay", "by")), F.lit(0))).withColumn(
        "r1",
        F.least(band(F.least("ay", "by")), F.lit(n_rows - 1))
    )
    e = e.filter("r1 >= r0").withColumn("row", F.explode(F.sequence("r0", "r1")))
    # The part of the edge between the row's two lines.
    at = lambda y: F.col("ax") + F.try_divide(F.least(F.greatest(y, F.least("ay", "by")), F.greatest("ay", "by")) - F.col("ay"), F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    p, q = F.coalesce(at(y0 - F.col("row") * res), F.col("ax")), F.coalesce(at(y0 - (F.col("row") + 1) * res), F.col("bx"))
    c0, c1 = F.greatest(F.floor((F.least(p, q) - x0) / res), F.lit(0)), F.least(F.floor((F.greatest(p, q) - x0) / res), F.lit(n_cols - 1))
    line = e.select(F.col("row").cast("int").alias("row"), c0.alias("c0"), c1.alias("c1")).filter("c1 >= c0")
    line = line.select("row", F.explode(F.sequence(F.col("c0").cast("int"), F.col("c1").cast("int"))).alias("col"))
    return line.union(rasterize(polygons, n_rows, x0, y0, res, n_cols).select("row", "col")).distinct()


def crop(px: DataFrame, polygons: DataFrame, n_rows: int, x0: float, y0: float, res: float, n_cols: int) -> DataFrame:
    """The pixels of ``px`` that the polygons touch."""
    return px.join(touched(polygons, n_rows, x0, y0, res, n_cols), ["row", "col"], "left_semi")


def _side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def _beside(points: DataFrame, polygons: DataFrame, step: float) -> DataFrame:
    """Points ``_p, x, y`` with the edges of polygons ``_q`` that share their band of y and a stretch of x that the polygon spans.

    Stretches are ``step`` wide, or so many doublings of it that a polygon lies in two or three. Outside a polygon's span of x its
    edges to the right are even in number, so points elsewhere need not see them."""
    band = lambda y: F.floor(y / step)
    xs = F.transform(F.flatten("rings"), lambda v: v[0])
    level = F.greatest(F.ceil(F.log2((F.col("_high") - F.col("_low")) / step)), F.lit(0))
    sized = polygons.withColumn("_low", F.array_min(xs)).withColumn("_high", F.array_max(xs)).withColumn("_level", level)
    wide = F.lit(step) * F.pow(F.lit(2.0), F.col("_level"))
    sized = sized.select("feature_id", "rings", "_level", F.floor(F.col("_low") / wide - SLACK).alias("_from"), F.floor(F.col("_high") / wide + SLACK).alias("_to"))
    e = edges(sized, "_level", "_from", "_to").filter("ay <> by").withColumn("_at", F.explode(F.sequence("_from", "_to")))
    e = e.select(
        F.col("feature_id").alias("_q"),
        "ax",
        "ay",
        "bx",
        "by",
        "_level",
        "_at",
        F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by")))).alias("_band")
    )
    levels = F.broadcast(sized.select("_level").filter("_level IS NOT NULL").distinct())  # a row a doubling: tens at most
    placed = points.crossJoin(levels).withColumn("_at", F.floor(F.col("x") / wide)).withColumn("_band", band(F.col("y")))
    return placed.join(e, ["_band", "_level", "_at"])


def _contained(points: DataFrame, polygons: DataFrame, step: float) -> DataFrame:
    """Pairs (_p, _q): the point of feature _p lies in polygon _q."""
    met = _beside(points, polygons, step).filter((F.col("y") >= F.least("ay", "by")) & (F.col("y") < F.greatest("ay", "by")))
    cross = F.col("ax") + (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    at = ["_p", "x", "y", "_q"]
    return met.filter(cross > F.col("x")).groupBy(*at).agg(F.count("*").alias("_n")).filter("_n % 2 = 1").select("_p", "_q")


SLACK = 1e-9  # of a square's side: what rounding may move a crossing by


def squares(polygons: DataFrame, step: float) -> DataFrame:
    """The edges with the squares of side ``step`` that they cross, ``_sx, _sy``: an edge walks through the columns of squares
    that it spans and takes in each the squares between its heights at the column's two sides. Rows grow with an edge's
    length over ``step``. Squares within a rounding error of the edge count as crossed."""
    low, high = F.floor(F.least("ax", "bx") / step - SLACK), F.floor(F.greatest("ax", "bx") / step + SLACK)
    e = edges(polygons).select("*", F.explode(F.sequence(low, high)).alias("_sx"))
    left, right = F.col("_sx") * step, (F.col("_sx") + 1) * step
    clamped = lambda x: F.least(F.greatest(x, F.least("ax", "bx")), F.greatest("ax", "bx"))
    height = lambda x: F.col("ay") + F.try_divide(clamped(x) - F.col("ax"), F.col("bx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    # An upright edge has no height at a place: it takes all squares between its ends.
    p, q = F.coalesce(height(left), F.col("ay")), F.coalesce(height(right), F.col("by"))
    slack = SLACK * step * (1 + F.try_divide(F.abs(F.col("by") - F.col("ay")), F.abs(F.col("bx") - F.col("ax"))))
    slack = F.least(F.coalesce(slack, F.lit(SLACK * step)), F.lit(step / 2))
    first, last = F.floor((F.least(p, q) - slack) / step), F.floor((F.greatest(p, q) + slack) / step)
    return e.select("*", F.explode(F.sequence(first, last)).alias("_sy"))


USUAL_EDGES = 16  # of areas in a square, up to which all areas are met at once


def meeting(features: DataFrame, areas: DataFrame, step: float) -> DataFrame:
    """``features`` that meet any of ``areas``: their edges cross or touch, or one holds the other.

    ``step`` is the side of the squares by which edges are matched: about the length of a usual edge. A longer edge is a row
    for each square that it crosses. Equal shapes are compared once. Where many areas share a square, a part of them chosen by
    hash comes first, then parts that make four times as many: features that have met one are not compared with the rest.
    Every shape without a hit is compared with every area near it.
    """
    features, areas = features.filter("feature_id IS NOT NULL"), _shapes(areas)
    crowd = squares(areas, step).groupBy("_sx", "_sy").count().agg(F.try_divide(F.sum(F.col("count") * F.col("count")), F.sum("count"))).first()[0]
    if (crowd or 0) <= USUAL_EDGES:
        shapes = _shapes(features)
        hits = _inside(shapes, areas, step).union(_crossing(shapes, areas, step)).union(_around(shapes, areas, step)).distinct()
        met = shapes.join(hits, "feature_id", "left_semi").select("rings")
        return features.join(met, "rings", "left_semi").select(*features.columns)
    place, seen, upto = F.pmod(F.xxhash64("feature_id"), F.lit(2**53)), 0, int(USUAL_EDGES / crowd * 2**53)
    tasks = 2 * features.sparkSession.sparkContext.defaultParallelism
    out = left = features.select("feature_id", "rings")
    while seen < 2**53 and not left.isEmpty():
        part = areas.filter((place >= seen) & (place < upto))
        # A corner is a row, an edge is one for each of its squares: corners first. What holds an area uncrossed comes last.
        for hits in (_inside, _crossing, _around):
            if left is out:
                out = written(left.join(hits(left, part, step), "feature_id", "left_anti"))
                left = _shapes(out)
            elif not left.isEmpty():
                dealt = left.repartition(tasks)  # few rows, but each of many squares and pairs
                before, left = left, written(left.join(hits(dealt, part, step), "feature_id", "left_anti"))
                if seen or hits is _around:
                    discard(before)
        seen, upto = upto, min(2**53, 4 * upto)
    met_none = out.alias("o").join(left.alias("l"), F.col("o.rings").eqNullSafe(F.col("l.rings")), "left_semi")
    return features.join(met_none.select("feature_id"), "feature_id", "left_anti")


def _shapes(polygons: DataFrame) -> DataFrame:
    """One polygon of each shape, under the least of its ids."""
    return polygons.groupBy("rings").agg(F.min("feature_id").alias("feature_id"))


def _crossing(features: DataFrame, areas: DataFrame, step: float) -> DataFrame:
    """``feature_id`` of features with an edge that crosses or touches one of an area."""

    def placed(polygons: DataFrame, key: str, prefix: str) -> DataFrame:
        return squares(polygons, step).select("_sx", "_sy", F.col("feature_id").alias(key), *[F.col(c).alias(prefix + c) for c in ("ax", "ay", "bx", "by")])

    met = placed(features, "_p", "f").join(placed(areas, "_q", "g"), ["_sx", "_sy"])
    fa, fb, ga, gb = ([F.col(f"{s}{end}x"), F.col(f"{s}{end}y")] for s in "fg" for end in "ab")
    boxes = [F.least(f"fa{k}", f"fb{k}") <= F.greatest(f"ga{k}", f"gb{k}") for k in "xy"] +[
        F.least(f"ga{k}", f"gb{k}") <= F.greatest(f"fa{k}", f"fb{k}") for k in "xy"
    ]
    apart = (_side(*fa, *fb, *ga) * _side(*fa, *fb, *gb) > 0) | (_side(*ga, *gb, *fa) * _side(*ga, *gb, *fb) > 0)
    return met.filter(boxes[0] & boxes[1] & boxes[2] & boxes[3] & ~apart).select(F.col("_p").alias("feature_id"))


def _corners(polygons: DataFrame) -> DataFrame:
    """A corner of each ring, as one of several parts may lie in an area that the others miss."""
    first = polygons.select(F.col("feature_id").alias("_p"), F.explode("rings").alias("r")).filter(F.size("r") > 1)
    return first.select("_p", F.col("r")[0][0].alias("x"), F.col("r")[0][1].alias("y")).distinct()


def _inside(features: DataFrame, areas: DataFrame, step: float) -> DataFrame:
    return _contained(_corners(features), areas, step).select(F.col("_p").alias("feature_id"))


def _around(features: DataFrame, areas: DataFrame, step: float) -> DataFrame:
    return _contained(_corners(areas), features, step).select(F.col("_q").alias("feature_id"))
