"""Queries of tiled layers, user aggregates, evaluation of several datasets, and shapes that are not rectangles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions import scalars as S
from pixelweave.operators import bagging as B
from pixelweave.operators import derived as D
from pixelweave.operators import evaluation as EV
from pixelweave.operators import geometry as GEO
from pixelweave.operators import models as M
from pixelweave.operators import neighborhood as N
from pixelweave.operators import sampling as P
from pixelweave.operators import spatial as SP
from pixelweave.operators import tiles as TI
from pixelweave.operators import workflows as WF
from pixelweave.plans.flows import folder, later
from pixelweave.plans.queries import FEATURES, scaled, split_rows
from pixelweave.plans.tables import AREA, PX, SQL, W, WIDTH, grid, parcels, query, rounded
from pixelweave.sources import layers as IO
from pixelweave.sources import tiled as TL
from pixelweave.sources.shared import written


def layer(px: DataFrame, name: str) -> TL.TiledLayer:
    """A column of the stack written as a tiled layer, and read back."""
    path = folder(px, f"tiles-{name}")
    TL.write_tiles(px.select("row", "col", PX(name).alias("value")), path, side=64, buckets=8)
    return TL.read_tiles(px.sparkSession, path)


query("tiled_stack", SQL["layer_stack"])(lambda px: TL.stack_tiles({"loss": layer(px, "loss"), "risk": layer(px.filter("risk > 10"), "risk")}))
query("tiled_rows", W + "SELECT row, col, risk FROM g WHERE row BETWEEN 40 AND 70")(
    lambda px: layer(px, "risk").rows(40, 70).pixels("risk").filter("row BETWEEN 40 AND 70")
)
query("tiled_map", W + "SELECT CAST(row // 64 AS BIGINT) AS tile_row, CAST(col // 64 AS BIGINT) AS tile_col, count(*) AS n, CAST(sum(risk) FILTER (WHERE loss = 1) AS BIGINT) AS lost FROM l GROUP BY 1, 2")(
    lambda px: TL.map_stacked(
        {"loss": layer(px, "loss"), "risk": layer(px, "risk")},
        lambda t: pd.DataFrame({"tile_row": [t["row"].iloc[0] // 64], "tile_col": [t["col"].iloc[0] // 64], "n": [len(t)], "lost": [t.loc[t["loss"] == 1, "risk"].sum()]}),
        "tile_row long, tile_col long, n long, lost long",
    )
)


def histogram(px: DataFrame, **by: int) -> DataFrame:
    """Pixels and events of each risk class, as a user's aggregate: a state is an array of counts."""

    def count(t: pd.DataFrame) -> np.ndarray:
        return np.stack([np.bincount(t["risk"], minlength=51), np.bincount(t["risk"][t["loss"] == 1], minlength=51)])

    def rows(state: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"risk": range(51), "n": state[0], "events": state[1]}).query("n > 0")

    kinds = ("band long, " if "band" in by else "") + "risk long, n long, events long"
    return TI.scan(px.select("row", "col", "risk", "loss"), count, np.add, rows, kinds, **by)


HISTOGRAM = W + "SELECT {band} CAST(risk AS BIGINT) AS risk, count(*) AS n, count(*) FILTER (WHERE loss = 1) AS events FROM l GROUP BY ALL"
query("scan_histogram", HISTOGRAM.format(band=""))(histogram)
query("scan_tile_histogram", HISTOGRAM.format(band=""))(lambda px: histogram(px, tile=32))
query("scan_band_histogram", HISTOGRAM.format(band="CAST(row // 30 AS BIGINT) AS band,"))(lambda px: histogram(px, band=30))


def two_datasets(px: DataFrame) -> DataFrame:
    """Maps of two periods, each against its own loss; one map of the second is a layer of its own, with fewer pixels."""
    second = later(px)
    runs = [
        EV.Run(px, {"a": PX("risk"), "b": 51 - PX("risk")}, WIDTH, 5, AREA, "calibration", "loss", models={"a": "GLM", "b": "RF"}),
        EV.Run(second, {"c": second.filter("risk > 5").select("row", "col", PX("risk").alias("value"))}, WIDTH, 4, AREA, "validation", "loss23", "forest_t2", "loss23", {"c": "GLM"}),
    ]
    return EV.evaluate(runs, [10, 15, 50])


query(
    "evaluate_datasets",
    W + """, m AS (SELECT row, col, forest_t1 AS f, loss AS y, 'a' AS prediction, 'GLM' AS model, 'calibration' AS period, 'loss' AS truth, 5 AS years, risk FROM l
UNION ALL SELECT row, col, forest_t1, loss, 'b', 'RF', 'calibration', 'loss', 5, 51 - risk FROM l
UNION ALL SELECT row, col, forest_t2, CASE WHEN forest_t2 = 1 AND forest_t3 = 0 THEN 1 WHEN forest_t2 = 1 AND forest_t3 = 1 THEN 0 END, 'c', 'GLM', 'validation', 'loss23', 4, risk FROM l WHERE risk > 5),
t AS (SELECT prediction, years, risk, CAST(count(*) FILTER (WHERE f = 1 OR y = 1) AS BIGINT) AS nfor, CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS ndefor,
  CASE WHEN risk = 1 THEN 0e0 ELSE ((risk - 2) * 999999e0 / 65533e0 + 1e0) * 1e-6 END AS rate FROM m GROUP BY ALL),
x AS (SELECT prediction, sum(ndefor) / sum(nfor * rate) AS k FROM t GROUP BY prediction),
r AS (SELECT t.prediction, risk, rate * k * 0.09e0 / years AS dens FROM t JOIN x ON t.prediction = x.prediction),
c AS (SELECT m.prediction, model, period, truth, z.csize, CAST(floor(row / z.csize) AS BIGINT) * CAST(ceil(150e0 / z.csize) AS BIGINT) + CAST(floor(col / z.csize) AS BIGINT) AS cell,
  count(*) FILTER (WHERE f = 1 OR y = 1) AS nfor, count(*) FILTER (WHERE y = 1) AS ndefor, coalesce(sum(dens), 0e0) * any_value(years) AS p
  FROM m CROSS JOIN (VALUES (10), (15), (50)) z(csize) LEFT JOIN r ON m.prediction = r.prediction AND m.risk = r.risk GROUP BY 1, 2, 3, 4, 5, 6 HAVING nfor > 0),
e AS (SELECT *, ndefor * 0.09e0 AS o, nfor * 0.09e0 AS w, p - ndefor * 0.09e0 AS e FROM c)
SELECT prediction, model, period, truth, csize, round(sqrt(avg(e * e)), 8) AS "RMSE", round(sqrt(sum(w * e * e) / sum(w)), 8) AS "wRMSE", round(quantile_cont(abs(e), 0.5), 8) AS "MedAE",
  round(pow(corr(p, o), 2), 8) AS "R2", count(*) AS ncell FROM e GROUP BY ALL""",
)(lambda px: rounded(two_datasets(px), 8))


# --- Points of tiled layers.

query("extract_tiled", SQL["extract_points"])(
    lambda px: P.extract_tiled(P.systematic(px, 5, 5), {n: layer(px, n) for n in ("elevation", "pa", "loss")}, WIDTH)
)

# --- Several windows in one pass.

query(
    "moving_windows",
    "SELECT a.row, a.col, a.ldefrate AS ldefrate_5, b.ldefrate AS ldefrate_11, c.ldefrate AS ldefrate_21 FROM ("
    + SQL["moving_window_5"] + ") a JOIN (" + SQL["moving_window_11"] + ") b ON a.row = b.row AND a.col = b.col JOIN (" + SQL["moving_window_21"] + ") c ON a.row = c.row AND a.col = c.col",
)(lambda px: WF.all_local_rates(px, WF.WindowModel(0.0, 0.0, (5, 11, 21), 5.0), "forest_t1", "loss"))

# --- Statistics of fits.

TREES = 20


def forest(px: DataFrame) -> tuple[B.Forest, DataFrame]:
    fitting, _ = split_rows(scaled(px))
    return B.forest_fit(fitting, "loss", FEATURES, trees=TREES), fitting


query("forest_statistics")(lambda px: (lambda f: rounded(B.forest_statistics(*f, "loss"), 6))(forest(px)))
query("bagged_forest_apply")(lambda px: B.forest_apply(forest(px)[0], scaled(px)).withColumn("code", S.risk_code(PX("p"))))


def spatial_model(px: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, float], DataFrame]:
    px = written(px)  # the fit, its sums and its statistics read it
    t = scaled(px).withColumn("cell", N.cell_index(PX("row"), PX("col"), 25, WIDTH))
    high = px.agg(F.max("row")).first()[0] // 25 + 1
    links = N.cell_neighbors(t.select("cell").distinct(), high, N.cells_across(25, WIDTH))
    return t, links, *M.spatial_fit(t, "loss", FEATURES, links)


def spatial_coefficients(px: DataFrame) -> DataFrame:
    t, links, beta, rho = spatial_model(px)
    return rounded(SP.coefficient_table(px.sparkSession, beta, SP.covariance(t, "loss", FEATURES, links, beta, rho)), 5)


def spatial_statistics(px: DataFrame) -> DataFrame:
    t, _, beta, rho = spatial_model(px)
    return rounded(SP.spatial_statistics(t, "loss", FEATURES, beta, rho), 5)


query("spatial_coefficients")(spatial_coefficients)
query("spatial_statistics")(spatial_statistics)
REACH = "WITH r AS (" + SQL["dist_threshold"] + "), n AS (" + W + "SELECT round(count(*) FILTER (WHERE loss = 1) * 0.09e0, 8) AS ha FROM l) SELECT dist_thresh, perc AS perc_thresh, ha AS tot_defor_ha{more} FROM r, n"
query("window_statistics", REACH.format(more=""))(lambda px: rounded(WF.threshold_statistics(px, "edge", "loss", AREA, 60.0), 8))
query("class_statistics", REACH.format(more=", 29 AS n_classes"))(lambda px: rounded(WF.threshold_statistics(px, "edge", "loss", AREA, 60.0, classes=29), 8))

# --- Layers made from other layers.


def dependent_run(px: DataFrame) -> DataFrame:
    """The forest layer is stale; the distance to its edge is on record as current, but is made from it, and follows it."""
    spark, at = px.sparkSession, folder(px, "dependent")
    raw = spark.createDataFrame(
        [(n, None, "raster", "continuous", None, True, 5) for n in ("away", "forest", "slope")], "name string, year int, data_type string, raster_type string, method string, active boolean, modified_at int"
    )
    out = spark.createDataFrame(
        [(n, None, "continuous", None, "g", f"/{n}", 9) for n in ("away", "slope")],
        "name string, year int, raster_type string, levels array<double>, grid_signature string, path string, modified_at int",
    )

    def run(key: str) -> tuple[DataFrame, str]:
        if key == "forest":
            return px.select("row", "col", PX("forest_t2").alias("value")), f"{at}/forest"
        base = IO.read_layer(spark, f"{at}/forest", "int")  # there is one only if the forest was done first
        return D.distance_layer(base, "value", "edge", 30.0).select("row", "col", PX("value_edge").alias("value")), f"{at}/{key}"

    done = WF.harmonise(raw, out, "g", run, lambda path, layer: IO.write_layer(layer, path), needs={"away": ["forest"], "slope": []})
    kinds = {"forest": "int", "away": "double"}
    parts = [IO.read_layer(spark, f"{at}/{k}", kinds[k]).select("row", "col", PX("value").cast("double").alias("value"), F.lit(k).alias("layer"), F.lit(i).alias("done")) for i, k in enumerate(done)]
    return rounded(parts[0].union(parts[1]), 6)


query(
    "harmonise_dependent",
    W + """, z AS (SELECT row, col FROM g WHERE forest_t2 = 0)
SELECT row, col, CAST(forest_t2 AS DOUBLE) AS value, 'forest' AS layer, 0 AS done FROM g
UNION ALL SELECT a.row, a.col, round(min(sqrt(pow(a.row - z.row, 2) + pow(a.col - z.col, 2))) * 30e0, 6), 'away', 1 FROM g a, z WHERE a.forest_t2 IS NOT NULL GROUP BY a.row, a.col""",
)(dependent_run)

# --- Shapes: triangles with slanted edges, concave corners, squares with a hole, one a nation.

X0, Y0, RES = 500_000.0, 100_000.0, 30.0
TRIANGLE = [(1.2, 1.3), (25.7, 4.1), (8.4, 17.6)]
CORNER = [(2.3, 2.3), (20.3, 2.3), (20.3, 8.3), (9.3, 8.3), (9.3, 17.3), (2.3, 17.3)]
OUTER, HOLE = [(3.3, 2.3), (22.3, 2.3), (22.3, 18.3), (3.3, 18.3)], [(8.3, 5.3), (15.3, 5.3), (15.3, 12.3), (8.3, 12.3)]


def shapes(spark: SparkSession, d: str) -> DataFrame:
    k = PX("n_nationkey")
    left, top = k % 5 * 30, F.floor(k / 5) * 20
    ring = lambda points: F.array(*[F.array(X0 + (left + x) * RES, Y0 - (top + y) * RES) for x, y in [*points, points[0]]])
    rings = F.when(k % 3 == 0, F.array(ring(TRIANGLE))).when(k % 3 == 1, F.array(ring(CORNER))).otherwise(F.array(ring(OUTER), ring(HOLE)))
    return spark.read.parquet(f"{d}/nation.parquet").select((k + 1).cast("long").alias("feature_id"), rings.alias("rings"))


def _sides(points: list[tuple[float, float]]) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    return list(zip(points, [*points[1:], points[0]], strict=True))


_INSIDE = " AND ".join(f"({bx - ax:.3f}e0 * (y - {ay}e0) - {by - ay:.3f}e0 * (x - {ax}e0) > 0)" for (ax, ay), (bx, by) in _sides(TRIANGLE))
# The unit square (x, y) to (x + 1, y + 1) meets the triangle if no edge of either parts them.
_MEETS = "x < 25.7e0 AND x + 1 > 1.2e0 AND y < 17.6e0 AND y + 1 > 1.3e0 AND " + " AND ".join(
    f"(greatest({bx - ax:.3f}e0 * (y - {ay}e0), {bx - ax:.3f}e0 * (y + 1 - {ay}e0)) + greatest({ay - by:.3f}e0 * (x - {ax}e0), {ay - by:.3f}e0 * (x + 1 - {ax}e0)) > 0)" for (ax, ay), (bx, by) in _sides(TRIANGLE)
)
_PLACE = W + ", p AS (SELECT g.row, g.col, k, g.col{at} - k % 5 * 30 AS x, g.row{at} - floor(k / 5) * 20 AS y FROM g, (SELECT n_nationkey AS k FROM nation)) "
query(
    "rasterize_shapes",
    _PLACE.format(at=" + 0.5e0") + f"""SELECT row, col, CAST(k + 1 AS INT) AS value FROM p WHERE CASE k % 3 WHEN 0 THEN {_INSIDE}
WHEN 1 THEN x > 2.3e0 AND y > 2.3e0 AND ((x < 20.3e0 AND y < 8.3e0) OR (x < 9.3e0 AND y < 17.3e0))
ELSE x > 3.3e0 AND x < 22.3e0 AND y > 2.3e0 AND y < 18.3e0 AND NOT (x > 8.3e0 AND x < 15.3e0 AND y > 5.3e0 AND y < 12.3e0) END""",
    lambda s, d: (grid(s, d), shapes(s, d)),
)(lambda t: IO.rasterize(t[1], t[0].n_rows, X0, Y0, RES, WIDTH, unique=True))
query(
    "touched_shapes",
    _PLACE.format(at="") + f"""SELECT row, col FROM p WHERE CASE k % 3 WHEN 0 THEN {_MEETS}
WHEN 1 THEN x + 1 > 2.3e0 AND y + 1 > 2.3e0 AND ((x < 20.3e0 AND y < 8.3e0) OR (x < 9.3e0 AND y < 17.3e0))
ELSE x + 1 > 3.3e0 AND x < 22.3e0 AND y + 1 > 2.3e0 AND y < 18.3e0 AND NOT (x > 8.3e0 AND x + 1 < 15.3e0 AND y > 5.3e0 AND y + 1 < 12.3e0) END""",
    lambda s, d: (grid(s, d), shapes(s, d)),
)(lambda t: GEO.touched(t[1], t[0].n_rows, X0, Y0, RES, WIDTH))


def slanted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Long thin triangles, and the suppliers' rectangles."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    x, y, w = PX("c_custkey") * 7 % 1000, PX("c_custkey") * 13 % 997, PX("c_nationkey") % 5 + 1.5
    corners = [(x, y), (x + w * 40, y + w * 13), (x + 3, y + w * 5), (x, y)]
    ring = F.array(*[F.array(a.cast("double"), b.cast("double")) for a, b in corners])
    return c.select(PX("c_custkey").cast("long").alias("feature_id"), F.array(ring).alias("rings")), parcels(spark, d)[1]


_AXES = ["1e0, 0e0", "0e0, 1e0", "-w * 13, w * 40", "w * 8, 3 - w * 40", "-w * 5, 3e0"]
_PARTS = [
    f"""(least(0e0, nx * w * 40 + ny * w * 13, nx * 3 + ny * w * 5) > dx * nx + dy * ny + greatest(0e0, nx * 20) + greatest(0e0, ny * 30)
  OR greatest(0e0, nx * w * 40 + ny * w * 13, nx * 3 + ny * w * 5) < dx * nx + dy * ny + least(0e0, nx * 20) + least(0e0, ny * 30))"""
]
query(
    "slanted_in_area",
    """WITH f AS (SELECT CAST(c_custkey AS BIGINT) AS feature_id, CAST(c_custkey * 7 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 13 % 997 AS DOUBLE) AS y, c_nationkey % 5 + 1.5e0 AS w FROM customer),
a AS (SELECT s_suppkey * 31 % 1000 + 0.25e0 AS u, s_suppkey * 17 % 997 + 0.25e0 AS v FROM supplier)
SELECT feature_id FROM f WHERE EXISTS (SELECT 1 FROM (SELECT u - x AS dx, v - y AS dy FROM a) WHERE NOT ("""
    + " OR ".join(_PARTS[0].replace("nx", f"({a.split(', ')[0]})").replace("ny", f"({a.split(', ')[1]})") for a in _AXES)
    + "))",
    slanted,
)(lambda t: GEO.meeting(*t, 16.0).select("feature_id"))
