"""Queries of single operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions import names as NA
from pixelweave.functions import scalars as S
from pixelweave.operators import catalog as C
from pixelweave.operators import derived as D
from pixelweave.operators import evaluation as EV
from pixelweave.operators import geometry as GEO
from pixelweave.operators import layers as L
from pixelweave.operators import models as M
from pixelweave.operators import neighborhood as N
from pixelweave.operators import rates as R
from pixelweave.operators import resample as RS
from pixelweave.operators import sampling as P
from pixelweave.operators import stats as T
from pixelweave.operators import summaries as U
from pixelweave.operators import tiles as TI
from pixelweave.plans.tables import AREA, COUNTS, PER_CAT, PX, RATE_COLS, SQL, WIDTH, YEARS, E, K, Q, W, borders, catalog, grid, parcels, pixels, query, rounded, trace

__all__ = ["Q", "SQL"]


def per_cat(px: DataFrame) -> DataFrame:
    return R.defrate_per_cat(px, YEARS, AREA)


def vulnerable(px: DataFrame) -> DataFrame:
    return px.withColumn("vuln", L.vulnerability(F.col("edge"), F.col("forest_t1"), F.col("subj"), [30.0, 500.0, 2000.0, 5000.0]))


def local(px: DataFrame, size: int) -> DataFrame:
    return N.local_rate(px, L.population(F.col("forest_t1"), F.col("loss")), L.event(F.col("loss")), size, YEARS)


def coarse(px: DataFrame, csize: int = 25) -> DataFrame:
    return R.cell_tally(px, per_cat(px), WIDTH, csize, YEARS, AREA)


query("loss_layer", W + "SELECT row, col, loss FROM l")(lambda px: px.select("row", "col", "loss"))
query("gain_layer", W + "SELECT row, col, CASE WHEN forest_t1 = 0 AND forest_t2 = 1 THEN 1 WHEN forest_t1 = 0 AND forest_t2 = 0 THEN 0 END AS gain FROM g")(
    lambda px: px.select("row", "col", L.change(PX("forest_t1"), PX("forest_t2"), "gain").alias("gain")))
query("inverse_loss", W + "SELECT row, col, 1 - loss AS loss FROM l")(
    lambda px: px.select("row", "col", L.change(PX("forest_t1"), PX("forest_t2"), "loss", 0).alias("loss"))
)
query("three_date_stack", W + "SELECT row, col, fcc FROM l")(lambda px: px.select("row", "col", "fcc"))
query(
    "loss_pairs",
    W + """SELECT 'forest_loss_2015_2020' AS pair, row, col, CASE WHEN forest_t1 = 1 AND forest_t2 = 0 THEN 1 WHEN forest_t1 = 1 AND forest_t2 = 1 THEN 0 END AS value FROM g
UNION ALL SELECT 'forest_loss_2015_2024', row, col, CASE WHEN forest_t1 = 1 AND forest_t3 = 0 THEN 1 WHEN forest_t1 = 1 AND forest_t3 = 1 THEN 0 END FROM g
UNION ALL SELECT 'forest_loss_2020_2024', row, col, CASE WHEN forest_t2 = 1 AND forest_t3 = 0 THEN 1 WHEN forest_t2 = 1 AND forest_t3 = 1 THEN 0 END FROM g"""
)(
    lambda px: L.loss_pairs(px, [(2015, "forest_t1"), (2020, "forest_t2"), (2024, "forest_t3")])
)
query("remap_binary", W + "SELECT row, col, CASE WHEN subj IN (1, 2, 3) THEN 1 WHEN subj IN (3, 4, 5, 6) THEN 0 END AS value FROM g")(
    lambda px: px.select("row", "col", L.to_binary(PX("subj"), [1, 2, 3], [3, 4, 5, 6]).alias("value")))
query("unmask", W + "SELECT row, col, coalesce(forest_t1, 0) AS value FROM g")(lambda px: px.select("row", "col", L.unmasked(PX("forest_t1")).alias("value")))
query("mask_pixels", W + "SELECT row, col, risk FROM g WHERE NOT (forest_t2 IS NULL OR forest_t2 IN (0))")(
    lambda px: px.filter(~L.suppressed(PX("forest_t2"), [0])).select("row", "col", "risk")
)
query("valid_count", W + "SELECT count(*) AS n FROM g WHERE forest_t1 IS NOT NULL AND coalesce(pa <> 0, false)")(
    lambda px: px.filter(L.valid(PX("forest_t1"), PX("pa"))).agg(F.count("*").alias("n"))
)
query("class_counts", W + "SELECT subj, count(*) AS n FROM g GROUP BY subj")(lambda px: U.class_counts(px, "subj"))
query("fixed_category_counts", W + """SELECT c.cat, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(1, 101)) AS BIGINT) AS cat) c
LEFT JOIN (SELECT risk, count(*) AS n FROM g GROUP BY risk) r ON c.cat = r.risk""")(lambda px: U.listed_counts(px, "risk", px.sparkSession.range(1, 101).toDF("cat")))
query("levels", W + "SELECT list_sort(list(DISTINCT subj)) AS levels FROM g WHERE subj IS NOT NULL")(lambda px: U.levels(px, "subj"))
query(
    "layer_summary",
    W + " ".join(
        [
            " UNION ALL ".join(
                f"SELECT '{c}' AS layer, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, count({c}) AS count FROM g" for c in (
                    "forest_t1",
                    "elevation",
                    "risk"
                )
            )
        ]
    )
)(
    lambda px: T.layer_summary(px, ["forest_t1", "elevation", "risk"]).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))
)
query("binary_guard", W + "SELECT min(loss) AS least, max(loss) AS most, NOT coalesce(min(loss) < 0 OR max(loss) > 1 OR max(loss) = 0, true) AS valid FROM l")(
    lambda px: U.binary_check(px, "loss"))
CODE = "CAST(floor((greatest({p}, 1e-6) * 1e6 - 1e0) * {span}e0 / 999999e0 + {low}e0) AS INT)"
query("rescale_risk", W + f"SELECT row, col, {CODE.format(p='risk / 64e0', span=65534, low=1)} AS code FROM g")(
    lambda px: px.select("row", "col", S.risk_code(PX("risk") / F.lit(64.0)).alias("code"))
)
query("import_contract", W + f"SELECT row, col, {CODE.format(p='least(greatest(risk / 32e0 - 0.25e0, 0e0), 1e0)', span=65534, low=1)} AS code FROM g")(
    lambda px: px.select("row", "col", S.import_code(PX("risk") / F.lit(32.0) - 0.25, "probability").alias("code")))
query("rate_mod", W + "SELECT DISTINCT risk, CASE WHEN risk = 1 THEN 0e0 ELSE round(((risk - 2) * 999999e0 / 65533e0 + 1e0) * 1e-6, 12) END AS rate FROM g")(
    lambda px: px.select("risk").distinct().select("risk", F.round(S.model_rate(PX("risk")), 12).alias("rate")))
query("defrate_per_cat", PER_CAT + RATE_COLS.format(dens="rate_mod * k"))(lambda px: rounded(per_cat(px)))
query("defrate_legacy", PER_CAT + RATE_COLS.format(dens="rate_obs"))(lambda px: rounded(R.defrate_per_cat(px, YEARS, AREA, density_from="rate_obs")))
query(
    "defrate_dense",
    "WITH d AS ("
    + SQL["defrate_per_cat"]
    + """) SELECT c.cat, coalesce(nfor, 0) AS nfor, coalesce(ndefor, 0) AS ndefor, 5e0 AS time_interval, rate_obs,
  round(CASE WHEN c.cat = 1 THEN 0e0 ELSE ((c.cat - 2) * 999999e0 / 65533e0 + 1e0) * 1e-6 END, 10) AS rate_mod, 0.09e0 AS pixel_area
FROM (SELECT CAST(unnest(range(1, 65536)) AS BIGINT) AS cat) c LEFT JOIN d ON c.cat = d.cat"""
)(lambda px: rounded(R.defrate_per_cat(px, YEARS, AREA, dense=65535)).drop("rate_abs", "defor_dens"))
VULN = "CASE WHEN (CASE WHEN forest_t1 = 1 THEN CASE WHEN edge > 5000 THEN 1 WHEN edge > 2000 THEN 1 WHEN edge > 500 THEN 2 WHEN edge > 30 THEN 3 ELSE 4 END ELSE 0 END) * 1000 + subj > 1000 THEN (CASE WHEN forest_t1 = 1 THEN CASE WHEN edge > 5000 THEN 1 WHEN edge > 2000 THEN 1 WHEN edge > 500 THEN 2 WHEN edge > 30 THEN 3 ELSE 4 END ELSE 0 END) * 1000 + subj END"
PER_CLASS = """s AS (SELECT *, 1e0 - pow(1e0 - CAST(ndefor AS DOUBLE) / nfor, 1e0 / 5e0) AS rate_obs, CAST(ndefor AS DOUBLE) / nfor AS rate_mod FROM t WHERE nfor > 0),
u AS (SELECT *, (SELECT sum(ndefor) / sum(nfor * rate_mod) FROM s) AS k FROM s) """
query("vulnerability", W + f"SELECT row, col, CAST({VULN} AS INT) AS vuln FROM l")(lambda px: vulnerable(px).select("row", "col", "vuln"))
query(
    "defrate_per_class",
    W + f", v AS (SELECT *, {VULN} AS vuln FROM l), " + COUNTS.format(
        cat="vuln",
        pop="forest_t1 = 1 OR loss = 1",
        ev="loss = 1",
        src="v"
    ) + ", " + PER_CLASS + RATE_COLS.format(dens="rate_mod * k")
)(
    lambda px: rounded(R.defrate_per_class(vulnerable(px), YEARS, AREA, "vuln"))
)
query(
    "defrate_fcc_period",
    W + ", " + COUNTS.format(cat="subj", pop="fcc > 1", ev="fcc = 2", src="l") + ", " + PER_CLASS + RATE_COLS.format(dens="rate_mod * k")
)(
    lambda px: rounded(R.defrate_per_class(R.period_layers(px, "fcc", "validation"), YEARS, AREA, "subj", "_forest", "_loss"))
)
CELLS = PER_CAT + """, r AS (SELECT cat, rate_mod * k * 0.09e0 / 5e0 AS dens FROM u), c AS (
SELECT {by} CAST(floor(row / {cs}) AS BIGINT) * CAST(ceil(150e0 / {cs}) AS BIGINT) + CAST(floor(col / {cs}) AS BIGINT) AS cell,
  count(*) FILTER (WHERE forest_t1 = 1 OR loss = 1) AS nfor_obs, count(*) FILTER (WHERE loss = 1) AS ndefor_obs, coalesce(sum(dens), 0e0) * 5 AS ndefor_pred_ha
FROM {src} LEFT JOIN r ON {src}.risk = r.cat GROUP BY ALL HAVING count(*) FILTER (WHERE forest_t1 = 1 OR loss = 1) > 0) """
query(
    "cell_tally",
    CELLS.format(
        by="",
        cs=25,
        src="l"
    ) + "SELECT cell, nfor_obs, ndefor_obs, round(nfor_obs * 0.09e0, 8) AS nfor_obs_ha, round(ndefor_obs * 0.09e0, 8) AS ndefor_obs_ha, round(ndefor_pred_ha, 8) AS ndefor_pred_ha FROM c"
)(lambda px: rounded(coarse(px), 8))
IDX = """SELECT {by} round(sqrt(avg(e * e)), 8) AS "RMSE", round(sqrt(sum(w * e * e) / sum(w)), 8) AS "wRMSE", round(quantile_cont(abs(e), 0.5), 8) AS "MedAE",
  round(pow(corr(p, o), 2), 8) AS "R2", count(*) AS ncell{cs} FROM (SELECT {by} ndefor_pred_ha AS p, ndefor_obs * 0.09e0 AS o, nfor_obs * 0.09e0 AS w, ndefor_pred_ha - ndefor_obs * 0.09e0 AS e FROM c) {group}"""
query("accuracy_indices", CELLS.format(by="", cs=25, src="l") + IDX.format(by="", cs="", group=""))(lambda px: rounded(R.accuracy(coarse(px)), 8))
INDICES_ALL = W + """, m AS (SELECT row, col, forest_t1, loss, 'a' AS prediction, risk FROM l UNION ALL SELECT row, col, forest_t1, loss, 'b', 51 - risk FROM l),
t AS (SELECT prediction, risk, CAST(count(*) FILTER (WHERE forest_t1 = 1 OR loss = 1) AS BIGINT) AS nfor, CAST(count(*) FILTER (WHERE loss = 1) AS BIGINT) AS ndefor,
  CASE WHEN risk = 1 THEN 0e0 ELSE ((risk - 2) * 999999e0 / 65533e0 + 1e0) * 1e-6 END AS rate FROM m GROUP BY ALL),
x AS (SELECT prediction, sum(ndefor) / sum(nfor * rate) AS k FROM t GROUP BY prediction),
r AS (SELECT t.prediction, risk, rate * k * 0.09e0 / 5e0 AS dens FROM t JOIN x ON t.prediction = x.prediction),
c AS (SELECT m.prediction, z.csize, CAST(floor(row / z.csize) AS BIGINT) * CAST(ceil(150e0 / z.csize) AS BIGINT) + CAST(floor(col / z.csize) AS BIGINT) AS cell,
  count(*) FILTER (WHERE forest_t1 = 1 OR loss = 1) AS nfor, count(*) FILTER (WHERE loss = 1) AS ndefor, coalesce(sum(dens), 0e0) * 5 AS p
  FROM m CROSS JOIN (VALUES (10), (25), (50)) z(csize) LEFT JOIN r ON m.prediction = r.prediction AND m.risk = r.risk GROUP BY 1, 2, 3 HAVING nfor > 0),
e AS (SELECT *, ndefor * 0.09e0 AS o, nfor * 0.09e0 AS w, p - ndefor * 0.09e0 AS e FROM c)
SELECT prediction, csize, round(sqrt(avg(e * e)), 8) AS "RMSE", round(sqrt(sum(w * e * e) / sum(w)), 8) AS "wRMSE", round(quantile_cont(abs(e), 0.5), 8) AS "MedAE",
  round(pow(corr(p, o), 2), 8) AS "R2", count(*) AS ncell FROM e GROUP BY prediction, csize"""
query("indices_all", INDICES_ALL)(lambda px: rounded(EV.evaluated(px, {"a": PX("risk"), "b": 51 - PX("risk")}, [10, 25, 50], WIDTH, YEARS, AREA), 8))
query(
    "tab_distance",
    W + """, b AS (SELECT unnest(range(1, 167)) AS bin), h AS (SELECT CASE WHEN edge > 0 AND edge <= 4980 THEN ceil(edge / 30e0) END AS bin FROM l WHERE loss = 1),
n AS (SELECT b.bin, count(h.bin) AS npix FROM b LEFT JOIN h ON b.bin = h.bin GROUP BY b.bin)
SELECT bin * 30e0 AS distance, npix, round(npix * 0.09e0, 8) AS area, round(sum(npix) OVER (ORDER BY bin) * 0.09e0, 8) AS cum,
  round(100e0 * sum(npix) OVER (ORDER BY bin) / (SELECT count(*) FROM h), 8) AS perc FROM n"""
)(
    lambda px: rounded(R.distance_table(px, "edge", "loss", 30.0, 5000.0, AREA), 8)
)
query(
    "dist_threshold",
    "WITH tab AS (" + SQL[
        "tab_distance"
    ] + ") SELECT min(distance) AS dist_thresh, round(arg_min(perc, distance), 2) AS perc FROM tab WHERE perc > 60"
)(
    lambda px: R.distance_threshold(R.distance_table(px, "edge", "loss", 30.0, 5000.0, AREA), 60.0)
)
WINDOW = W + """, m AS (SELECT row, col, CASE WHEN forest_t1 = 1 OR loss = 1 THEN 1 ELSE 0 END AS n, CASE WHEN loss = 1 THEN 1 ELSE 0 END AS d FROM l),
w AS (SELECT a.row, a.col, a.n AS own, sum(b.n) AS n, sum(b.d) AS d FROM m a JOIN m b ON b.row BETWEEN a.row - {h} AND a.row + {h} AND b.col BETWEEN a.col - {h} AND a.col + {h} GROUP BY a.row, a.col, a.n)
SELECT row, col, CASE WHEN own = 0 THEN 0 ELSE {code} END AS ldefrate FROM w"""
for _size in (5, 11, 21):
    query(
        f"moving_window_{_size}",
        WINDOW.format(h=_size // 2, code=CODE.format(p="1e0 - pow(1e0 - CAST(d AS DOUBLE) / n, 1e0 / 5e0)", span=65533, low=2))
    )(lambda px, s=_size: local(px, s))
query("dist_to_edge", W + """, z AS (SELECT row, col FROM l WHERE forest_t1 = 0)
SELECT a.row, a.col, round(min(sqrt(pow(a.row - z.row, 2) + pow(a.col - z.col, 2))) * 30e0, 6) AS dist FROM l a, z WHERE a.forest_t1 IS NOT NULL GROUP BY a.row, a.col""")(
    lambda px: D.distance_layer(px, "forest_t1", "edge", 30.0).select("row", "col", F.round("forest_t1_edge", 6).alias("dist")))
query(
    "slope",
    W + """, s AS (SELECT row - r AS row, col - c AS col, sum(c * (2 - abs(r)) * elevation) AS x, sum(r * (2 - abs(c)) * elevation) AS y FROM g, (VALUES (-1), (0), (1)) p(r), (VALUES (-1), (0), (1)) q(c) GROUP BY 1, 2 HAVING count(*) = 9)
SELECT row, col, round(degrees(atan(sqrt(x * x + y * y) / 240e0)), 8) AS slope FROM s"""
)(
    lambda px: N.slope(px, "elevation", 30.0).withColumn("slope", F.round("slope", 8))
)
query("systematic_count", W + """, s AS (SELECT CAST(greatest(1, round_even(sqrt(count(*) / 500e0), 0)) AS INT) AS k FROM g WHERE forest_t1 IS NOT NULL)
SELECT row, col FROM g, s WHERE forest_t1 IS NOT NULL AND row % k = 0 AND col % k = 0""", lambda s, d: (pixels(s, d), grid(s, d)))(
    lambda t: P.points(t[0], "forest_t1", t[1], "systematic", n=500).select("row", "col"))
query("systematic_spacing", W + "SELECT row, col FROM g WHERE forest_t1 IS NOT NULL AND row % 7 = 0 AND col % 7 = 0")(
    lambda px: P.systematic(px.filter("forest_t1 IS NOT NULL"), 7, 7).select("row", "col")
)
_counts = lambda px: px.groupBy("subj").agg(F.count("*").alias("n"))
query(
    "alloc_equal",
    W + ", k AS (SELECT subj, count(*) AS n FROM g GROUP BY subj) SELECT subj, n, CAST(least(floor(1000 / (SELECT count(*) FROM k)), n) AS BIGINT) AS n_alloc FROM k"
)(
    lambda px: P.allocate_equal(_counts(px), 1000)
)
query(
    "alloc_proportional",
    W + ", k AS (SELECT subj, count(*) AS n FROM g GROUP BY subj) SELECT subj, n, CAST(least(round_even(1000e0 * n / (SELECT sum(n) FROM k), 0), n) AS BIGINT) AS n_alloc FROM k"
)(
    lambda px: P.allocate_proportional(_counts(px), 1000)
)
ADAPT = "CAST(CASE WHEN {a} >= 50000 THEN 50000 WHEN {a} <= 10000 THEN 10000 ELSE round_even({a}, 0) END AS BIGINT)"
query(
    "alloc_adaptive",
    W + ", k AS (SELECT pa, count(*) AS n FROM g GROUP BY pa) SELECT pa, n, least(n, " + ADAPT.format(
        a="1000 * (700e0 * (SELECT sum(n) FROM k)) / 1e6"
    ) + ") AS n_alloc FROM k"
)(
    lambda px: P.allocate_each(px.groupBy("pa").agg(F.count("*").alias("n")), 100, 700.0)
)
query(
    "adaptive_sizes",
    W + ", k AS (SELECT risk, CAST(risk * 333 AS BIGINT) AS n FROM g GROUP BY risk) SELECT risk, " + ADAPT.format(
        a="1000 * (3500e0 * n) / 1e6"
    ) + " AS size FROM k"
)(
    lambda px: px.select("risk", P.adaptive_size(PX("risk") * 333, 3500.0).alias("size")).distinct()
)
query("alloc_each", W + ", k AS (SELECT subj, count(*) AS n FROM g GROUP BY subj) SELECT subj, n, least(n, 590) AS n_alloc FROM k")(
    lambda px: P.allocate_each(_counts(px), 590)
)
query("random_points")(lambda px: P.random_points(px.filter("loss IS NOT NULL").select("row", "col", "loss"), 500, 1))
query("stratified_points")(lambda px: P.stratified_points(px.filter("loss IS NOT NULL").select("row", "col", "loss"), "loss", {0: 300, 1: 200}, 1))
query("valid_rank", W + "SELECT row, col, row_number() OVER (ORDER BY row, col) - 1 AS rank FROM g WHERE forest_t1 IS NOT NULL")(
    lambda px: P.ranked(px.filter("forest_t1 IS NOT NULL").select("row", "col"))
)
query(
    "extract_points",
    W + "SELECT elevation, pa, loss, CAST(row AS BIGINT) * 150 + col AS cell_id, 1 AS trial FROM l WHERE row % 5 = 0 AND col % 5 = 0 AND elevation IS NOT NULL AND pa IS NOT NULL AND loss IS NOT NULL"
)(
    lambda px: P.extract(P.systematic(px, 5, 5), px, ["elevation", "pa", "loss"], WIDTH)
)
query("cell_index", W + "SELECT row, col, CAST(floor(row / 20) AS BIGINT) * 8 + CAST(floor(col / 20) AS BIGINT) AS cell FROM g")(
    lambda px: px.select("row", "col", N.cell_index(PX("row"), PX("col"), 20, WIDTH).alias("cell"))
)
query(
    "cell_neighbors",
    W + ", k AS (SELECT DISTINCT CAST(floor(row / 50) AS BIGINT) * 3 + CAST(floor(col / 50) AS BIGINT) AS cell FROM g), n AS (SELECT max(cell) // 3 + 1 AS nr FROM k) SELECT k.cell, (k.cell // 3 + a.x) * 3 + k.cell % 3 + b.y AS neighbor FROM k, n, (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(y) WHERE (x <> 0 OR y <> 0) AND k.cell // 3 + x BETWEEN 0 AND nr - 1 AND k.cell % 3 + y BETWEEN 0 AND 2"
)(
    lambda px: N.cell_neighbors(
        px.select(N.cell_index(PX("row"), PX("col"), 50, WIDTH).alias("cell")).distinct(),
        px.agg(F.max("row")).first()[0] // 50 + 1,
        N.cells_across(50, WIDTH)
    )
)
PROJ = "(SELECT CAST(risk AS BIGINT) AS cat, count(*) AS npix FROM g WHERE pa = 1 AND risk <> 0 GROUP BY risk)"
_project = lambda px: U.project_counts(px, "risk", PX("pa"))
query("project_counts", W + "SELECT * FROM " + PROJ)(lambda px: U.project_counts(px, "risk", PX("pa")))
query(
    "allocation_totals",
    PER_CAT + ", d AS (SELECT cat, rate_mod * (1000e0 / (0.09e0 * (SELECT sum(nfor * rate_mod) FROM s))) * 0.09e0 / 4 AS dens FROM s), a AS (SELECT sum(npix * coalesce(dens, 0)) AS ha FROM " + PROJ + " p LEFT JOIN d ON p.cat = d.cat) SELECT 'annual' AS period, 1 AS length, round(ha, 8) AS deforestation FROM a UNION ALL SELECT 'entire', 4, round(ha * 4, 8) FROM a"
)(
    lambda px: rounded(R.allocation(_project(px), per_cat(px), 1000.0, 4, AREA), 8)
)
query(
    "density_map",
    PER_CAT + "SELECT row, col, round(coalesce(rate_mod * k * 0.09e0 / 5e0, 0e0), 10) AS dens FROM l LEFT JOIN u ON l.risk = u.cat WHERE pa = 1"
)(
    lambda px: rounded(U.densities(px.filter("pa = 1"), per_cat(px)))
)
query("uncovered_classes", W + "SELECT DISTINCT risk FROM g WHERE risk NOT IN (SELECT DISTINCT risk FROM g WHERE forest_t1 = 1 AND risk % 7 <> 0)")(
    lambda px: U.uncovered(px, px.filter("forest_t1 = 1 AND risk % 7 <> 0"), "risk"))
query(
    "rate_table_faults",
    PER_CAT + """, b AS (SELECT cat - CASE WHEN cat % 10 = 9 THEN 1 ELSE 0 END + CASE WHEN cat % 10 = 5 THEN 0.5e0 ELSE 0e0 END AS cat, nfor - CASE WHEN cat % 17 = 3 THEN 100000 ELSE 0 END AS nfor,
  CASE WHEN cat % 13 = 2 THEN NULL ELSE rate_mod END AS rate_mod, CASE WHEN cat % 11 = 4 THEN -0.09e0 ELSE 0.09e0 END AS pixel_area FROM u)
SELECT 0 AS missing_columns, count(*) FILTER (WHERE cat <> floor(cat)) AS not_whole, count(*) FILTER (WHERE cat <= 0) AS not_positive, count(cat) - count(DISTINCT cat) AS repeated,
  count(*) FILTER (WHERE rate_mod IS NULL) AS not_finite, count(*) FILTER (WHERE nfor < 0) + count(*) FILTER (WHERE rate_mod < 0) + count(*) FILTER (WHERE pixel_area < 0) AS negative,
  CAST(count(DISTINCT pixel_area) <> 1 AS INT) AS areas_differ, CAST(min(pixel_area) <= 0 AS INT) AS no_area, CAST(coalesce(sum(nfor * rate_mod), 0) <= 0 AS INT) AS no_risk FROM b"""
)(
    lambda px: R.rate_table_faults(
        per_cat(px).select(
            (PX("cat") - F.when(PX("cat") % 10 == 9, 1).otherwise(0) + F.when(PX("cat") % 10 == 5, 0.5).otherwise(0.0)).alias("cat"),
            (PX("nfor") - F.when(PX("cat") % 17 == 3, 100000).otherwise(0)).alias("nfor"),
            F.when(PX("cat") % 13 != 2, PX("rate_mod")).alias("rate_mod"),
            F.when(PX("cat") % 11 == 4, -0.09).otherwise(0.09).alias("pixel_area")
        )
    )
)
query(
    "deviance",
    W + ", t AS (SELECT loss AS y, (risk + 1) / 60e0 AS p FROM l WHERE loss IS NOT NULL) SELECT round(-2 * sum(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS deviance, round(-2 * count(y) * (avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y))), 6) AS null_deviance FROM t"
)(
    lambda px: rounded(
        T.deviance(px.filter("loss IS NOT NULL").select(F.col("loss").alias("y"), ((PX("risk") + 1) / F.lit(60.0)).alias("p")), "y", "p"),
        6
    )
)
query(
    "regrid_nearest",
    W + "SELECT t.row, t.col, g.elevation FROM g t LEFT JOIN g ON g.row = floor((t.row + 0.5e0) / 3e0) AND g.col = floor((t.col + 0.5e0) / 3e0)"
)(
    lambda px: RS.regrid(px, px, "elevation", 3.0)
)
query(
    "regrid_bilinear",
    W + """, t AS (SELECT row, col, floor((row + 0.5e0) / 4e0 - 0.5e0) AS r0, floor((col + 0.5e0) / 4e0 - 0.5e0) AS c0, (row + 0.5e0) / 4e0 - 0.5e0 AS y, (col + 0.5e0) / 4e0 - 0.5e0 AS x FROM g),
n AS (SELECT t.row, t.col, r0 + a AS sr, c0 + b AS sc, (CASE WHEN a = 1 THEN y - r0 ELSE 1 - (y - r0) END) * (CASE WHEN b = 1 THEN x - c0 ELSE 1 - (x - c0) END) AS w FROM t, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b))
SELECT n.row, n.col, round(sum(w * elevation) / sum(w) FILTER (WHERE elevation IS NOT NULL), 8) AS elevation FROM n LEFT JOIN g ON g.row = n.sr AND g.col = n.sc GROUP BY n.row, n.col"""
)(
    lambda px: RS.regrid(px, px, "elevation", 4.0, True).withColumn("elevation", F.round("elevation", 8))
)
query("thin_scatter", W + """, b AS (SELECT min(elevation) AS x0, max(elevation) AS x1, min(risk) AS y0, max(risk) AS y1, count(*) > 10000 AS many FROM g),
t AS (SELECT row * 150 + col AS id, elevation, risk, many, least(floor((elevation - x0) * 200 / (x1 - x0)), 199) AS bx, least(floor((risk - y0) * 200 / (y1 - y0)), 199) AS by_ FROM g, b)
SELECT id, elevation, risk FROM t QUALIFY NOT many OR row_number() OVER (PARTITION BY bx, by_ ORDER BY id) = 1""")(lambda px: T.thin_scatter(px.select((PX("row") * 150 + PX("col")).alias("id"), "elevation", "risk"), "elevation", "risk", "id"))
query("axis_bounds", W + "SELECT least(min(elevation), min(risk)) AS low, greatest(max(elevation), max(risk)) AS high FROM g")(
    lambda px: U.axis_bounds(px, "elevation", "risk")
)
query(
    "pivot_metrics",
    W + 'SELECT subj, round(max(e) FILTER (WHERE pa = 0), 6) AS "0", round(max(e) FILTER (WHERE pa = 1), 6) AS "1" FROM (SELECT subj, pa, avg(elevation) AS e FROM g GROUP BY subj, pa) GROUP BY subj'
)(
    lambda px: T.pivot_metric(px.groupBy("subj", "pa").agg(F.round(F.avg("elevation"), 6).alias("e")), "subj", "pa", "e", [0, 1])
)
query("labels", W + "SELECT DISTINCT 'MW_w5_val_' || CAST(subj AS VARCHAR) AS label FROM g")(
    lambda px: px.select("subj").distinct().select(
        NA.run_label(F.lit("mw_calib_a"), F.lit(5), F.concat(F.lit("val "), PX("subj").cast("string"), F.lit("!"))).alias("label")
    )
)
query(
    "trace_summary",
    "WITH " + E + " SELECT param, round(avg(value), 8) AS estimate, round(stddev_samp(value), 8) AS std, round(quantile_cont(value, 0.025), 8) AS ci_low, round(quantile_cont(value, 0.975), 8) AS ci_high FROM e GROUP BY param",
    trace
)(
    lambda t: rounded(T.trace_summary(t), 8)
)
query(
    "split_rhat",
    "WITH " + E + """, i AS (SELECT *, row_number() OVER (PARTITION BY param ORDER BY iter) AS i, count(*) OVER (PARTITION BY param) // 2 AS h FROM e), h AS (SELECT param, i > h AS half, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM i WHERE i <= 2 * h GROUP BY 1, 2),
p AS (SELECT param, avg(v) AS w, var_samp(m) AS b, min(n) AS n FROM h GROUP BY param) SELECT param, round(CASE WHEN w > 0 AND n > 1 THEN sqrt(((n - 1e0) / n * w + b) / w) END, 8) AS rhat FROM p""",
    trace
)(lambda t: rounded(T.split_rhat(t), 8))
query(
    "stretch",
    "SELECT round(quantile_cont(CAST(value AS DOUBLE), 0.02), 8) AS low, round(quantile_cont(CAST(value AS DOUBLE), 0.98), 8) AS high FROM events",
    trace
)(
    lambda t: rounded(U.stretch(t, "value"), 8)
)
query(
    "importance_top",
    "WITH " + E + " SELECT variable, round(importance, 6) AS importance FROM (SELECT 'v' || CAST(iter % 40 AS VARCHAR) AS variable, sum(value) AS importance FROM e GROUP BY 1) ORDER BY importance DESC, variable LIMIT 15",
    trace
)(
    lambda t: rounded(T.importance_top(t.select(F.concat(F.lit("v"), (PX("iter") % 40).cast("string")).alias("variable"), "value")), 6)
)
_coefs = lambda t: t.select(PX("param").alias("variable"), PX("iter").alias("level"), (PX("value") - 50).alias("estimate"), (PX("value") - 80).alias("ci_low"), (PX("value") - 20).alias("ci_high"))
query(
    "strongest_contrast",
    "WITH " + E + " SELECT variable, level, estimate, ci_low, ci_high FROM (SELECT param AS variable, iter AS level, value - 50 AS estimate, value - 80 AS ci_low, value - 20 AS ci_high FROM e) QUALIFY row_number() OVER (PARTITION BY variable ORDER BY CAST(ci_low > 0 OR ci_high < 0 AS INT) DESC, abs(estimate) DESC, level) = 1",
    trace
)(
    lambda t: T.strongest_contrast(_coefs(t))
)

query("catalog_tags", "WITH " + K + " SELECT id, name FROM k WHERE m = 0", catalog)(lambda c: C.with_tags(c, ["raw", "mask"], True).select("id", "name"))
query("catalog_any_tag", "WITH " + K + " SELECT id, name FROM k WHERE m IN (0, 2)", catalog)(lambda c: C.with_tags(c, ["mask", "dist"]).select("id", "name"))
query("catalog_filter", "WITH " + K + " SELECT id FROM k WHERE name IN ('nation_12', 'nation_16', 'nation_18') AND year > 2001", catalog)(
    lambda c: C.select_layers(c, name=["nation_12", "nation_16", "nation_18"], year=lambda y: y > 2001).select("id"))
query(
    "catalog_years",
    "WITH " + K + " SELECT name, list_sort(list(DISTINCT year)) AS years, count(DISTINCT year) > 1 AS temporal FROM k GROUP BY name",
    catalog
)(C.years_per_name)
query("catalog_common_years", "WITH " + K + """, t AS (SELECT id % 3 AS name, year FROM k)
SELECT year FROM t GROUP BY year HAVING count(DISTINCT name) = (SELECT count(DISTINCT name) FROM t)""", catalog)(lambda c: C.common_years(c.withColumn("name", PX("id") % 3)))
query("catalog_lookup", "WITH " + K + " SELECT id, year FROM k WHERE name = 'nation_16' AND year = 2008", catalog)(
    lambda c: C.lookup(c, "nation_16", 2008).select("id", "year")
)
query("layer_files", "WITH " + K + " SELECT id, path FROM k WHERE path LIKE '%nation_1%' AND path LIKE '%20%' AND path NOT LIKE '%nation_11%'", catalog)(
    lambda c: C.files_with(c, ["Nation_1", "20"], ["nation_11"]).select("id", "path"))
query("layer_files_strict", "WITH " + K + """ SELECT id, path FROM k WHERE (regexp_matches(path, '(^|[^0-9a-z])nation_1([^0-9a-z]|$)') OR path LIKE '%12%')
AND NOT regexp_matches(path, '(^|[^0-9a-z])tif\\.x([^0-9a-z]|$)')""", catalog)(lambda c: C.files_with_tokens(c, ["nation_1", "12"], ["tif.x"]).select("id", "path"))
query(
    "override_union",
    "WITH " + K + " SELECT name, year, CASE WHEN count(*) FILTER (WHERE m = 0) > 0 THEN 'processed' ELSE 'raw' END AS source FROM k GROUP BY name, year",
    catalog
)(
    lambda c: C.processed_first(
        c.select("name", "year", F.lit("raw").alias("source")).distinct(),
        c.filter("id % 3 = 0").select("name", "year", F.lit("processed").alias("source")).distinct()
    )
)
query(
    "unique_ids",
    "SELECT n_name, dense_rank() OVER (ORDER BY n_name) AS id FROM nation",
    lambda s, d: s.read.parquet(f"{d}/nation.parquet")
)(lambda n: D.numbered(n, "n_name"))
query(
    "period_reduce",
    "SELECT user_id, round(sum(value) * 1000, 6) AS total, round(avg(value) - 273.15e0, 6) AS mean, max(CAST(value AS DOUBLE)) AS high, min(CAST(value AS DOUBLE)) AS low, quantile_cont(CAST(value AS DOUBLE), 0.5) AS median FROM events GROUP BY user_id",
    lambda s, d: s.read.parquet(f"{d}/events.parquet")
)(
    lambda e: e.groupBy("user_id").agg(
        F.round(F.sum("value") * 1000, 6).alias("total"),
        F.round(F.avg("value") - 273.15, 6).alias("mean"),
        F.max(PX("value").cast("double")).alias("high"),
        F.min(PX("value").cast("double")).alias("low"),
        F.percentile(PX("value").cast("double"), F.lit(0.5)).alias("median")
    )
)

FEATURES = ["height", "pa", "away"]


def scaled(px: DataFrame) -> DataFrame:
    return px.withColumn("height", PX("elevation") / 100_000).withColumn("away", PX("edge") / 1_000)


FIT_ROWS = 50_000  # the forest is fitted on at most about so many pixels, and at most half of them


def split_rows(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fitting pixels, chosen by a hash of their place, and all the others."""
    known = px.filter("loss IS NOT NULL")
    share = min(0.5, FIT_ROWS / max(1, known.count()))
    chosen = F.pmod(F.xxhash64("row", "col"), F.lit(2**53)) < int(share * 2**53)
    return known.filter(chosen), known.filter(~chosen)


def forest(px: DataFrame):
    return M.forest_fit(split_rows(scaled(px))[0], "loss", FEATURES)


def spatial(px: DataFrame):
    t = scaled(px).withColumn("cell", N.cell_index(PX("row"), PX("col"), 25, WIDTH))
    high = px.agg(F.max("row")).first()[0] // 25 + 1
    return M.spatial_fit(t, "loss", FEATURES, N.cell_neighbors(t.select("cell").distinct(), high, N.cells_across(25, WIDTH)))[1]


query("glm_fit")(lambda px: rounded(M.glm_fit(scaled(px), "loss", FEATURES), 6))
query("forest_importance")(lambda px: M.forest_importance(forest(px), px, FEATURES))
query("forest_apply")(lambda px: M.forest_apply(forest(px), scaled(px), FEATURES).withColumn("code", S.risk_code(PX("p"))))
query("forest_held_out_accuracy")(lambda px: M.accuracy_of(M.forest_apply(forest(px), split_rows(scaled(px))[1], FEATURES, ("loss",)), "loss", "p"))
query("spatial_fit")(lambda px: spatial(px).withColumn("rho", F.round("rho", 6)))
query(
    "spread_effect",
    W + """, k AS (SELECT CAST(floor(row / 25) AS INT) AS row, CAST(floor(col / 25) AS INT) AS col, avg(forest_t1) - 0.8e0 AS rho FROM g GROUP BY 1, 2),
t AS (SELECT row, col, floor((row + 0.5e0) / 25e0 - 0.5e0) AS r0, floor((col + 0.5e0) / 25e0 - 0.5e0) AS c0, (row + 0.5e0) / 25e0 - 0.5e0 AS y, (col + 0.5e0) / 25e0 - 0.5e0 AS x FROM g),
n AS (SELECT t.row, t.col, r0 + a AS sr, c0 + b AS sc, (CASE WHEN a = 1 THEN y - r0 ELSE 1 - (y - r0) END) * (CASE WHEN b = 1 THEN x - c0 ELSE 1 - (x - c0) END) AS w FROM t, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b))
SELECT n.row, n.col, round(sum(w * rho) / sum(w) FILTER (WHERE rho IS NOT NULL), 8) AS rho FROM n LEFT JOIN k ON k.row = n.sr AND k.col = n.sc GROUP BY n.row, n.col"""
)(
    lambda px: M.spread_effect(
        px.groupBy(N.cell_index(PX("row"), PX("col"), 25, WIDTH).alias("cell")).agg((F.avg("forest_t1") - 0.8).alias("rho")),
        N.cells_across(25, WIDTH),
        25,
        px
    ).withColumn("rho", F.round("rho", 8))
)
query(
    "effective_sample_size",
    "WITH " + E + """, i AS (SELECT param, row_number() OVER (PARTITION BY param ORDER BY iter) AS i, value - avg(value) OVER (PARTITION BY param) AS c FROM e),
v AS (SELECT param, sum(c * c) AS v, count(*) AS n FROM i GROUP BY param), r AS (SELECT a.param, b.i - a.i AS t, sum(a.c * b.c) AS s FROM i a JOIN i b ON a.param = b.param AND b.i > a.i GROUP BY 1, 2),
p AS (SELECT r.param, (t + 1) // 2 AS k, sum(s) / min(v) AS pair, count(*) AS m FROM r JOIN v ON r.param = v.param GROUP BY 1, 2), f AS (SELECT param, min(k) FILTER (WHERE pair <= 0 OR m < 2) AS stop FROM p GROUP BY param),
s AS (SELECT p.param, sum(pair) AS tail FROM p JOIN f ON p.param = f.param WHERE stop IS NULL OR k < stop GROUP BY p.param)
SELECT v.param, round(greatest(least(n / (1 + 2 * coalesce(tail, 0)), n), 1), 6) AS ess FROM v LEFT JOIN s ON v.param = s.param""",
    trace
)(
    lambda t: rounded(T.effective_sample_size(t), 6)
)
query(
    "map_tiles",
    W + "SELECT CAST(floor(row / 50) AS BIGINT) AS tile_row, CAST(floor(col / 50) AS BIGINT) AS tile_col, count(*) AS n, sum(risk)::BIGINT AS total FROM g GROUP BY 1, 2"
)(
    lambda px: TI.map_tiles(
        px.select("row", "col", "risk"),
        lambda t: (t.iloc[:1][["row", "col"]] // 50).set_axis(["tile_row", "tile_col"], axis=1).assign(n=len(t), total=t["risk"].sum()),
        "tile_row long, tile_col long, n long, total long",
        50
    )
)
query("predict_with", W + "SELECT row, col, round(1e0 / (1e0 + exp(3e0 - risk / 10e0)), 9) AS p FROM g")(
    lambda px: TI.predict_with(px.select("row", "col", "risk"), lambda t: 1 / (1 + 2.718281828459045 ** (3 - t["risk"] / 10))).withColumn("p", F.round("p", 9)))


query("crop_to_border", W + "SELECT row, col, risk FROM g WHERE row BETWEEN 1 AND 7 AND col % 30 BETWEEN 2 AND 17", lambda s, d: (pixels(s, d), borders(s, d)))(
    lambda t: GEO.crop(t[0].select("row", "col", "risk"), t[1], 1_000_000, 0.0, 0.0, 1.0, WIDTH))
query(
    "features_in_area",
    """WITH f AS (SELECT CAST(c_custkey AS BIGINT) AS feature_id, c_custkey * 7 % 1000 AS x, c_custkey * 13 % 997 AS y, c_nationkey % 5 + 1.5e0 AS w FROM customer),
a AS (SELECT s_suppkey * 31 % 1000 + 0.25e0 AS u, s_suppkey * 17 % 997 + 0.25e0 AS v FROM supplier)
SELECT feature_id FROM f WHERE EXISTS (SELECT 1 FROM a WHERE x <= u + 20 AND u <= x + w AND y <= v + 30 AND v <= y + w)""",
    parcels
)(
    lambda t: GEO.meeting(*t, 16.0).select("feature_id")
)

_dates = lambda c: C.years_per_name(c).filter(F.size("years") > 2).select("name", *[PX("years")[i].alias(f"y{i + 1}") for i in range(3)])
query(
    "periods",
    "WITH " + K + """, d AS (SELECT name, y[1] AS y1, y[2] AS y2, y[3] AS y3 FROM (SELECT name, list_sort(list(DISTINCT year)) AS y FROM k GROUP BY name) WHERE len(y) > 2)
SELECT name, 'calibration' AS period, 'calibration' AS train_period, y1 AS initial_year, y2 AS final_year, [1] AS defor_values, y2 - y1 AS time_interval, y1 AS layer_year FROM d
UNION ALL SELECT name, 'validation', 'calibration', y2, y3, [1], y3 - y2, y2 FROM d UNION ALL SELECT name, 'historical', 'historical', y1, y3, [1, 2], y3 - y1, y1 FROM d
UNION ALL SELECT name, 'forecast', 'historical', y1, y3, [1, 2], y3 - y1, y3 FROM d""",
    catalog
)(lambda c: C.periods(_dates(c)))
query(
    "rate_table_source",
    "WITH " + K + """, c AS (SELECT name AS prediction, ['import', 'mw', 'jnr', 'other'][length(name) % 4 + 1] AS kind, ['evaluation', 'sibling', 'persisted', 'computed', 'evaluation', 'user'][id % 6 + 1] AS source, path, year FROM k),
r AS (SELECT *, CASE WHEN source = 'user' THEN 0 WHEN source = 'evaluation' AND kind = 'import' THEN 1 WHEN source = 'persisted' AND kind <> 'import' THEN 2 WHEN source = 'sibling' AND kind = 'mw' THEN 3 WHEN source = 'computed' AND kind = 'other' THEN 4 END AS p FROM c)
SELECT prediction, source, path FROM r WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY prediction ORDER BY p, year DESC, path) = 1""",
    catalog
)(
    lambda c: C.rate_table_source(
        c.select(
            PX("name").alias("prediction"),
            F.array(*map(F.lit, ("import", "mw", "jnr", "other")))[F.length("name") % 4].alias("kind"),
            F.array(
                *map(F.lit, ("evaluation", "sibling", "persisted", "computed", "evaluation", "user"))
            )[(PX("id") % 6).cast("int")].alias("source"),
            "path",
            F.make_date("year", F.lit(1), F.lit(1)).alias("made_at")
        )
    )
)
