"""Queries of whole runs (models, imports, allocation, catalog work) and of names, derived layers, checks and sources.

The SQL of a fitted model's map takes the fit's own numbers only where SQL can find them too (thresholds, edges, scaling).
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions import names as NA
from pixelweave.functions import scalars as S
from pixelweave.grid import GridSpec, stack
from pixelweave.operators import catalog as C
from pixelweave.operators import derived as D
from pixelweave.operators import design as DE
from pixelweave.operators import evaluation as EV
from pixelweave.operators import geometry as GEO
from pixelweave.operators import imports as I
from pixelweave.operators import layers as L
from pixelweave.operators import models as M
from pixelweave.operators import neighborhood as N
from pixelweave.operators import rates as R
from pixelweave.operators import resample as RS
from pixelweave.operators import sampling as P
from pixelweave.operators import stats as T
from pixelweave.operators import summaries as U
from pixelweave.operators import tiles as TI
from pixelweave.operators import workflows as WF
from pixelweave.plans.queries import CODE, WINDOW
from pixelweave.plans.tables import AREA, COUNTS, E, K, PER_CAT, PX, RATE_COLS, SQL, W, WIDTH, YEARS, borders, box, catalog, grid, pixels, query, rounded, trace
from pixelweave.sources import layers as IO
from pixelweave.sources.shared import shared_dir, written

X0, Y0, RES = 500_000.0, 100_000.0, 30.0
PERCENT = 60.0


def later(px: DataFrame) -> DataFrame:
    """The stack with the loss of its second interval."""
    return px.withColumn("loss23", L.change(PX("forest_t2"), PX("forest_t3"), "loss"))


def both(spark: SparkSession, d: str) -> tuple[DataFrame, GridSpec]:
    return pixels(spark, d), grid(spark, d)


def folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


# --- Window and class models: fit, apply, rate tables of another period.

THRESHOLD = "p AS (SELECT min(distance) AS reach, arg_min(perc, distance) AS perc FROM (" + SQL["tab_distance"] + ") WHERE perc > 60)"
LOSS23 = "CASE WHEN forest_t2 = 1 AND forest_t3 = 0 THEN 1 WHEN forest_t2 = 1 AND forest_t3 = 1 THEN 0 END"


def table_sql(src: str, pop: str, ev: str, years: int, mod: str, cat: str) -> str:
    """CTEs t, s, u of a rate table; ``mod`` is the relative rate of a row of t."""
    return (
        COUNTS.format(cat=cat, pop=pop, ev=ev, src=src)
        + f""", s AS (SELECT *, CASE WHEN nfor > 0 THEN 1e0 - pow(1e0 - CAST(ndefor AS DOUBLE) / nfor, 1e0 / {years}e0) END AS rate_obs, {mod} AS rate_mod FROM t),
u AS (SELECT *, (SELECT sum(ndefor) / sum(nfor * rate_mod) FROM s) AS k FROM s)"""
    )


def rate_columns(years: int) -> str:
    return RATE_COLS.format(dens="rate_mod * k").replace("5e0 AS time_interval", f"{years}e0 AS time_interval").replace("0.09e0 / 5e0", f"0.09e0 / {years}e0")


def window_model(px: DataFrame) -> WF.WindowModel:
    return WF.window_fit(px, "edge", "loss", YEARS, AREA, (5, 11), PERCENT)


def class_model(px: DataFrame) -> WF.ClassModel:
    return WF.class_fit(px, "edge", "loss", RES, AREA, PERCENT)


def class_rates(px: DataFrame, model: WF.ClassModel, rates: DataFrame | None = None, second: bool = False) -> DataFrame:
    forest, loss = ("forest_t2", "loss23") if second else ("forest_t1", "loss")
    return WF.class_apply(later(px), model, "edge", forest, loss, "subj", 4 if second else YEARS, AREA, rates)[1]


def calibrated_rates(px: DataFrame) -> DataFrame:
    """The second interval's rate table, with the relative rates of the first. The stack is read by several jobs: it is
    written once, and the model is fitted once."""
    px = written(px)
    model = class_model(px)
    return class_rates(px, model, class_rates(px, model).select("cat", "rate_mod"), True)


query(
    "window_fit",
    "WITH " + THRESHOLD + " SELECT reach AS dist_thresh, round(perc, 2) AS perc_thresh, w AS \"window\" FROM p, (VALUES (5), (11)) w(w)"
)(
    lambda px: (
        lambda m: px.sparkSession.createDataFrame(
            [(m.dist_thresh, m.perc_thresh, w) for w in m.windows],
            "dist_thresh double, perc_thresh double, window int"
        )
    )(window_model(px))
)
RATE_OF_CODE = "CASE WHEN cat = 1 THEN 0e0 ELSE ((cat - 2) * 999999e0 / 65533e0 + 1e0) * 1e-6 END"
WINDOW_MAP = (
    WINDOW.format(h=2, code=CODE.format(p="1e0 - pow(1e0 - CAST(d AS DOUBLE) / n, 1e0 / 5e0)", span=65533, low=2)).replace(
        "SELECT row, col, CASE WHEN own",
        ", mw AS (SELECT row, col, CASE WHEN own"
    ) + "), " + THRESHOLD + f", x AS (SELECT l.row, l.col, forest_t2, {LOSS23} AS loss23, CASE WHEN edge > reach THEN 1 ELSE ldefrate END AS risk FROM l JOIN mw ON l.row = mw.row AND l.col = mw.col, p WHERE ldefrate > 0)"
)


def window_run(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    px = written(px)  # the fit, the local rates and the map read it
    m = window_model(px)
    return WF.window_apply(WF.local_rates(px, m, 5, "forest_t1", "loss"), later(px), m, "edge", "forest_t2", "loss23", 4, AREA)


query(
    "mw_apply",
    WINDOW_MAP + ", " + table_sql("x", "forest_t2 = 1 OR loss23 = 1", "loss23 = 1", 4, RATE_OF_CODE, "risk") + rate_columns(4)
)(lambda px: rounded(window_run(px)[1]))
query("mw_map", WINDOW_MAP + " SELECT row, col, risk FROM x")(lambda px: window_run(px)[0])

EDGES = "d AS (SELECT unnest(range(0, 30)) AS i), e AS (SELECT i, CASE WHEN i = 0 THEN 30e0 ELSE reach * pow(30e0 / reach, (29 - i) / 29e0) END AS x FROM d, p)"
CLASSES = (
    W
    + ", "
    + THRESHOLD
    + ", "
    + EDGES
    + f""", v AS (SELECT l.*, {LOSS23} AS loss23, CASE WHEN edge > reach THEN 1 ELSE 30 - (SELECT count(*) FROM e WHERE e.x < l.edge) END AS c FROM l, p),
vv AS (SELECT *, CASE WHEN (CASE WHEN {{f}} = 1 THEN c ELSE 0 END) * 1000 + subj > 1000 THEN (CASE WHEN {{f}} = 1 THEN c ELSE 0 END) * 1000 + subj END AS vuln FROM v)"""
)
query("class_fit", "WITH " + THRESHOLD + ", " + EDGES + " SELECT CAST(i AS INT) AS i, round(x, 8) AS edge FROM e")(
    lambda px: (
        lambda m: px.sparkSession.createDataFrame(list(enumerate(m.edges)), "i int, edge double").withColumn("edge", F.round("edge", 8))
    )(class_model(px))
)
query("class_map", CLASSES.format(f="forest_t1") + " SELECT row, col, CAST(vuln AS INT) AS vuln FROM vv")(
    lambda px: WF.class_apply(px, class_model(px), "edge", "forest_t1", "loss", "subj", YEARS, AREA)[0]
)
OWN = "CAST(ndefor AS DOUBLE) / nfor"
CALIBRATED = CLASSES.format(f="forest_t1") + ", " + COUNTS.format(
    cat="vuln",
    pop="forest_t1 = 1 OR loss = 1",
    ev="loss = 1",
    src="vv"
).replace("t AS", "t0 AS", 1)
query(
    "jnr_apply",
    CALIBRATED + ", w2 AS (SELECT *, CASE WHEN (CASE WHEN forest_t2 = 1 THEN c ELSE 0 END) * 1000 + subj > 1000 THEN (CASE WHEN forest_t2 = 1 THEN c ELSE 0 END) * 1000 + subj END AS vuln2 FROM v), " + table_sql(
        "w2",
        "forest_t2 = 1 OR loss23 = 1",
        "loss23 = 1",
        4,
        "(SELECT CAST(t0.ndefor AS DOUBLE) / t0.nfor FROM t0 WHERE t0.cat = t.cat AND t0.nfor > 0)",
        "vuln2"
    ).replace("FROM t)", "FROM t WHERE nfor > 0)") + rate_columns(4),
)(
    lambda px: rounded(calibrated_rates(px))
)


def periods_sql() -> str:
    parts = []
    for name, fitted, pop, ev, years in (
        ("calibration", "", "fcc > 0", "fcc = 1", 5), ("validation", "calibration", "fcc > 1", "fcc = 2", 4), ("historical", "", "fcc > 0", "fcc IN (1, 2)", 9), ("forecast", "historical", "fcc > 0", "fcc IN (1, 2)", 9),
    ):
        mod = f"(SELECT rate_mod FROM s_{fitted} f WHERE f.cat = t_{name}.cat)" if fitted else OWN
        one = table_sql("l", pop, ev, years, mod, "subj").replace("FROM t)", "FROM t WHERE nfor > 0)")
        for cte in "tsu":
            one = re.sub(rf"\b{cte} AS \(", f"{cte}_{name} AS (", re.sub(rf"FROM {cte}\b(?!_)", f"FROM {cte}_{name}", one))
        parts.append((name, one, years))
    picks = [rate_columns(y).replace("SELECT cat", f"SELECT '{n}' AS period, cat").replace("FROM u", f"FROM u_{n}") for n, _, y in parts]
    return W + ", " + ", ".join(p for _, p, _ in parts) + " " + " UNION ALL ".join(picks)


query("period_rates", periods_sql())(
    lambda px: rounded(WF.period_rates(px, "fcc", "subj", {"calibration": 5, "validation": 4, "historical": 9, "forecast": 9}, AREA))
)

# --- Event models: design, fit, apply.

SPEC = DE.from_roles(
    "loss",
    {"elevation": "continuous", "edge": "continuous", "pa": "categorical", "subj": "categorical"},
    {"pa": (0, 1), "subj": tuple(range(1, 26))}
)
COEFS = {"Intercept": -1.0, "scale(elevation)": 0.5, "scale(edge)": -0.25, "C(pa, levels=[0, 1])[T.1]": 0.8} |{
    f"C(subj, levels={list(range(1, 26))})[T.{k}]": k / 40 for k in range(2, 26)
}
ETA = """m AS (SELECT avg(elevation) AS m1, stddev_pop(elevation) AS s1, avg(edge) AS m2, stddev_pop(edge) AS s2 FROM l WHERE loss IS NOT NULL),
eta AS (SELECT row, col, -1e0 + CASE WHEN pa = 1 THEN 0.8e0 ELSE 0e0 END + CASE WHEN subj > 1 THEN subj / 40e0 ELSE 0e0 END + 0.5e0 * (elevation - m1) / s1 - 0.25e0 * (edge - m2) / s2 AS eta FROM l, m)"""
query("glm_apply", W + ", " + ETA + " SELECT row, col, round(1e0 / (1e0 + exp(-eta)), 9) AS p FROM eta")(
    lambda px: rounded(DE.applied(px, SPEC.frozen(px), COEFS), 9)
)
CELL_EFFECT = """, k AS (SELECT CAST(floor(row / 25) AS INT) AS row, CAST(floor(col / 25) AS INT) AS col, avg(forest_t1) - 0.8e0 AS rho FROM g GROUP BY 1, 2),
b AS (SELECT row, col, floor((row + 0.5e0) / 25e0 - 0.5e0) AS r0, floor((col + 0.5e0) / 25e0 - 0.5e0) AS c0, (row + 0.5e0) / 25e0 - 0.5e0 AS y, (col + 0.5e0) / 25e0 - 0.5e0 AS x FROM g),
n AS (SELECT b.row, b.col, r0 + i AS sr, c0 + j AS sc, (CASE WHEN i = 1 THEN y - r0 ELSE 1 - (y - r0) END) * (CASE WHEN j = 1 THEN x - c0 ELSE 1 - (x - c0) END) AS w FROM b, (VALUES (0), (1)) p1(i), (VALUES (0), (1)) q1(j)),
f AS (SELECT n.row, n.col, sum(w * rho) / sum(w) FILTER (WHERE rho IS NOT NULL) AS rho FROM n LEFT JOIN k ON k.row = n.sr AND k.col = n.sc GROUP BY n.row, n.col)"""


def with_effect(px: DataFrame, rho: DataFrame) -> DataFrame:
    return px.join(M.spread_effect(rho, N.cells_across(25, WIDTH), 25, px), ["row", "col"])


query(
    "icar_apply",
    W + CELL_EFFECT + ", " + ETA + " SELECT eta.row, eta.col, round(1e0 / (1e0 + exp(-(eta + rho))), 9) AS p FROM eta JOIN f ON f.row = eta.row AND f.col = eta.col"
)(
    lambda px: rounded(
        DE.applied(
            with_effect(px, px.groupBy(N.cell_index(PX("row"), PX("col"), 25, WIDTH).alias("cell")).agg((F.avg("forest_t1") - 0.8).alias("rho"))),
            SPEC.frozen(px),
            COEFS,
            "rho"
        ),
        9
    )
)
query(
    "design_rows",
    W + """, m AS (SELECT avg(elevation) AS m1, stddev_pop(elevation) AS s1, avg(edge) AS m2, stddev_pop(edge) AS s2 FROM l WHERE loss IS NOT NULL)
SELECT CAST(loss AS DOUBLE) AS y, CAST(pa = 1 AS DOUBLE) AS pa1, CAST(subj = 2 AS DOUBLE) AS subj2, CAST(subj = 25 AS DOUBLE) AS subj25, round((elevation - m1) / s1, 8) AS x1, round((edge - m2) / s2, 8) AS x2 FROM l, m WHERE loss IS NOT NULL"""
)(
    lambda px: rounded(
        DE.design_rows(px, SPEC.frozen(px)).select(
            PX("_y").alias("y"),
            PX("_x0").alias("pa1"),
            PX("_x1").alias("subj2"),
            PX("_x24").alias("subj25"),
            PX("_x25").alias("x1"),
            PX("_x26").alias("x2")
        ),
        8
    )
)
query(
    "unseen_levels",
    W + "SELECT 'subj' AS variable, CAST(subj AS DOUBLE) AS value FROM (SELECT DISTINCT subj FROM g WHERE subj > 12 ORDER BY subj LIMIT 10)"
)(
    lambda px: DE.ModelSpec("loss", (), {"pa": (0, 1), "subj": tuple(range(1, 13))}).unseen(px)
)




def formula(px: DataFrame) -> DataFrame:
    """The formula of roles, with the levels that the layers hold."""
    found = {c: tuple(U.levels(px, c).first()["levels"]) for c in ("pa", "subj")}
    spec = DE.from_roles("loss", {"elevation": "continuous", "pa": "categorical", "subj": "categorical"}, found)
    return px.sparkSession.createDataFrame([(spec.formula(), spec.formula(False))], "formula string, shown string")


query(
    "model_formula",
    W + """SELECT 'I(loss) + trial ~ scale(elevation) + C(pa, levels=[' || (SELECT string_agg(CAST(pa AS VARCHAR), ', ' ORDER BY pa) FROM (SELECT DISTINCT pa FROM g)) || ']) + C(subj, levels=[' ||
(SELECT string_agg(CAST(subj AS VARCHAR), ', ' ORDER BY subj) FROM (SELECT DISTINCT subj FROM g)) || '])' AS formula, 'I(loss) + trial ~ scale(elevation) + C(pa) + C(subj)' AS shown"""
)(formula)
query(
    "predict_design",
    W + ", " + ETA.replace("-1e0 + CASE", "CASE").replace(" - 0.25e0 * (edge - m2) / s2", "") + " SELECT row, col, round(eta, 9) AS p FROM eta"
)(
    lambda px: rounded(TI.predict_design(px, SPEC.frozen(px), lambda x: sum(x[t] * b for t, b in COEFS.items() if t in x and t != "scale(edge)")), 9)
)


def fitted(px: DataFrame) -> tuple[DE.ModelSpec, dict[str, float]]:
    return DE.fitted(px, SPEC)


def glm_map(px: DataFrame) -> DataFrame:
    px = written(px)  # the scaling, the fit and the map read it
    return DE.applied(px, *fitted(px)).select("row", "col", S.risk_code(PX("p")).alias("risk"))


query("glm_map")(glm_map)
query("glm_coefficients")(lambda px: rounded(DE.coefficient_table(px.sparkSession, fitted(px)[1]), 5))
query("glm_statistics")(lambda px: rounded(DE.fit_statistics(px, *fitted(px)), 4))


def spatial_run(px: DataFrame) -> DataFrame:
    """Fit with an effect per cell, the effect spread over the pixels, and the map."""
    px = written(px)
    spec = DE.ModelSpec("loss", ("elevation", "edge"), {"pa": (0, 1)}).frozen(px)
    t = DE.design_rows(px.withColumn("_cell", N.cell_index(PX("row"), PX("col"), 25, WIDTH)), spec)
    terms = spec.terms()
    cells = px.select("loss", *spec.features, N.cell_index(PX("row"), PX("col"), 25, WIDTH).alias("cell")).dropna(subset=["loss"])
    rows = cells.select("cell", PX("loss").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(spec.columns())])
    high = px.agg(F.max("row")).first()[0] // 25 + 1
    names = [c for c in t.columns if c != "_y"]
    beta, rho = M.spatial_fit(rows, "_y", names, N.cell_neighbors(rows.select("cell").distinct(), high, N.cells_across(25, WIDTH)))
    coefs = {"Intercept": beta["Intercept"]} | {term: beta[n] for term, n in zip(terms, names, strict=True)}
    return DE.applied(with_effect(px, rho), spec, coefs, "rho")


query("icar_map")(lambda px: spatial_run(px).select("row", "col", S.risk_code(PX("p")).alias("risk")))
query(
    "effect_summary",
    W + ", k AS (SELECT avg(forest_t1) - 0.8e0 AS rho FROM g GROUP BY floor(row / 25), floor(col / 25)) SELECT round(min(rho), 8) AS min, round(max(rho), 8) AS max, round(avg(rho), 8) AS mean, round(stddev_pop(rho), 8) AS std FROM k"
)(
    lambda px: rounded(
        U.effect_summary(px.groupBy(F.floor(PX("row") / 25), F.floor(PX("col") / 25)).agg((F.avg("forest_t1") - 0.8).alias("rho"))),
        8
    )
)
query(
    "posterior_table",
    "SELECT s.param AS term, round(estimate, 6) AS estimate, round(std, 6) AS std, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(rhat, 6) AS rhat, ess FROM ("
    + SQL["trace_summary"] + ") s LEFT JOIN (" + SQL["split_rhat"] + ") r ON s.param = r.param LEFT JOIN (" + SQL["effective_sample_size"] + ") n ON s.param = n.param",
    trace,
)(lambda t: rounded(DE.posterior_table(t), 6))
query(
    "worst_mixing",
    "WITH " + E + ", d AS (SELECT iter % 5 AS kind, CASE WHEN iter % 7 > 0 THEN 1e0 + value / 1000 END AS rhat, CASE WHEN iter % 3 > 0 THEN 50 + value END AS ess FROM e) SELECT kind, round(max(rhat), 8) AS rhat, round(min(ess), 8) AS ess, max(rhat) > 1.1e0 OR min(ess) < 100 AS bad FROM d GROUP BY kind HAVING max(rhat) IS NOT NULL AND min(ess) IS NOT NULL",
    trace
)(
    lambda t: rounded(
        U.worst_mixing(
            t.select(
                (PX("iter") % 5).alias("kind"),
                F.when(PX("iter") % 7 > 0, 1 + PX("value") / 1000).alias("rhat"),
                F.when(PX("iter") % 3 > 0, 50 + PX("value")).alias("ess")
            )
        ),
        8
    )
)

# --- Outside maps.

query(
    "import_scale",
    W + """, r AS (SELECT min(risk / 40e0) AS least, max(risk / 40e0) AS most FROM g)
SELECT 'probability' AS scale, least, most, CASE WHEN most > 1 THEN 'above 1' END AS fault FROM r UNION ALL SELECT 'risk', least, most, CASE WHEN most <= 1 THEN 'a probability map' WHEN most > 65535 THEN 'above 65535' END FROM r"""
)(
    lambda px: (
        lambda t: I.scale_faults(t, "v", "probability").withColumn("scale", F.lit("probability")).unionByName(
            I.scale_faults(t, "v", "risk").withColumn("scale", F.lit("risk"))
        )
    )(
        px.select((PX("risk") / F.lit(40.0)).alias("v"))
    )
)
PLACED = "SELECT t.row, t.col, {v} AS risk FROM g t LEFT JOIN g s ON s.row = floor((t.row + 0.5e0) / 3e0 + 1) AND s.col = floor((t.col + 0.5e0) / 3e0 + 2)"
query(
    "import_risk",
    W + PLACED.format(
        v="CASE WHEN least(greatest(round_even(s.elevation / 4 - 3000, 0), 0), 65535) > 0 THEN CAST(least(greatest(round_even(s.elevation / 4 - 3000, 0), 0), 65535) AS INT) END"
    )
)(
    lambda px: I.imported(px.withColumn("v", PX("elevation") / 4 - 3000), "v", "risk", px, 3.0, (1.0, 2.0), checked=False)
)
query(
    "import_probability",
    W + PLACED.format(v=CODE.format(p="s.risk / 64e0", span=65534, low=1)).replace(
        "greatest(s.risk / 64e0, 1e-6)",
        "CASE WHEN s.risk IS NOT NULL THEN greatest(s.risk / 64e0, 1e-6) END"
    )
)(
    lambda px: I.imported(px.withColumn("v", PX("risk") / F.lit(64.0)), "v", "probability", px, 3.0, (1.0, 2.0))
)
query(
    "layer_inspect",
    W + "SELECT 'double' AS type, count(elevation) AS n, min(elevation) AS least, max(elevation) AS most, max(row) + 1 AS n_rows FROM g",
    both
)(
    lambda t: (
        lambda r: t[0].sparkSession.createDataFrame(
            [(r["type"], r["count"], r["least"], r["most"], r["shape"][0])],
            "type string, n long, least double, most double, n_rows int"
        )
    )(I.inspect(t[0], "elevation", t[1]))
)
query("value_range", W + "SELECT CAST(min(risk) AS DOUBLE) AS least, CAST(max(risk) AS DOUBLE) AS most FROM g")(lambda px: U.range_or_unit(px, "risk"))
query("all_nodata", W + "SELECT count(forest_t1) = 0 AS all_nodata FROM g WHERE forest_t1 IS NULL OR pa = 2")(
    lambda px: U.all_nodata(px.filter("forest_t1 IS NULL OR pa = 2"), "forest_t1")
)

# --- Allocation and evaluation.


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles on the stack's grid, one a region."""
    x = X0 + F.col("r_regionkey") * 900 + 69
    return spark.read.parquet(f"{d}/region.parquet").select(
        F.col("r_regionkey").cast("long").alias("feature_id"),
        F.lit("Polygon").alias("kind"),
        box(x, F.lit(Y0 - 231.0), x + 459, F.lit(Y0 - 42.0))
    )


INSIDE = "row BETWEEN 1 AND 7 AND col % 30 BETWEEN 2 AND 17"
query("allocate", PER_CAT + f""", d AS (SELECT cat, rate_mod * (1000e0 / (0.09e0 * (SELECT sum(nfor * rate_mod) FROM s))) * 0.09e0 / 4 AS dens FROM s),
c AS (SELECT risk AS cat, count(*) AS npix FROM l WHERE {INSIDE} AND pa = 0 AND risk <> 0 GROUP BY risk), a AS (SELECT sum(npix * coalesce(dens, 0)) AS ha FROM c LEFT JOIN d ON c.cat = d.cat)
SELECT 'annual' AS period, 1 AS length, round(ha, 8) AS deforestation FROM a UNION ALL SELECT 'entire', 4, round(ha * 4, 8) FROM a""", lambda s, d: (pixels(s, d), grid(s, d), projects(s, d)))(
    lambda t: rounded(WF.allocate(t[0], R.defrate_per_cat(t[0], YEARS, AREA), t[2], 1000.0, 4, t[1], mask=1 - PX("pa")), 8)
)
query(
    "allocation_density",
    PER_CAT + "SELECT row, col, round(coalesce(rate_mod * 1000e0 / (SELECT sum(nfor * rate_mod) FROM s) / 4, 0e0), 10) AS dens FROM l LEFT JOIN s ON l.risk = s.cat"
)(
    lambda px: rounded(WF.density_map(px, R.defrate_per_cat(px, YEARS, AREA), 1000.0, 4))
)
query(
    "border_faults",
    "SELECT CAST(count(*) = 0 AS INT) AS no_features, count(*) FILTER (WHERE r_regionkey = 3) AS empty, count(*) FILTER (WHERE r_regionkey = 1) AS not_polygons FROM region",
    projects
)(
    lambda b: U.border_faults(
        b.select(
            F.when(PX("feature_id") == 1, "LineString").otherwise(PX("kind")).alias("kind"),
            F.when(PX("feature_id") != 3, PX("rings")).alias("rings")
        )
    )
)
query(
    "ordered_indices",
    SQL["indices_all"].replace("SELECT prediction, csize", "SELECT prediction AS model, 'p' AS period, csize").replace(', 8) AS "', ', 6) AS "')
)(
    lambda px: rounded(
        U.ordered_indices(
            EV.evaluated(px, {"a": PX("risk"), "b": 51 - PX("risk")}, [10, 25, 50], WIDTH, YEARS, AREA).select(
                PX("prediction").alias("model"),
                F.lit("p").alias("period"),
                "csize",
                "RMSE",
                "wRMSE",
                "MedAE",
                "R2",
                "ncell"
            )
        ),
        6
    )
)
query("shown_metrics", "SELECT prediction, csize, \"R2\", ncell FROM (" + SQL["indices_all"] + ")")(
    lambda px: rounded(U.shown_metrics(EV.evaluated(px, {"a": PX("risk"), "b": 51 - PX("risk")}, [10, 25, 50], WIDTH, YEARS, AREA), ["R2"]), 8)
)
query(
    "rounded_indices",
    "SELECT prediction, csize, " + ", ".join(f"CAST(printf('%.2f', \"{m}\") AS DOUBLE) AS \"{m}\"" for m in ("RMSE", "wRMSE", "MedAE", "R2")) + ", ncell FROM (" + SQL[
        "indices_all"
    ] + ")"
)(
    lambda px: U.rounded_indices(EV.evaluated(px, {"a": PX("risk"), "b": 51 - PX("risk")}, [10, 25, 50], WIDTH, YEARS, AREA))
)
query(
    "distance_recovered",
    "WITH tab AS (" + SQL[
        "tab_distance"
    ]+ ") SELECT round(100e0 * arg_max(cum, distance) / arg_max(perc, distance), 4) AS total_ha, round(max(perc) FILTER (WHERE distance = 3000), 2) AS perc FROM tab"
)(
    lambda px: U.recovered_totals(
        rounded(R.distance_table(px, "edge", "loss", RES, 5000.0, AREA), 8),
        3000.0
    ).withColumn("total_ha", F.round("total_ha", 4))
)
query(
    "normalised_map",
    W + "SELECT row, col, round(risk / (SELECT CAST(max(risk) AS DOUBLE) FROM g WHERE pa = 1 AND risk <> 50), 10) AS value FROM g WHERE pa = 1 AND risk <> 50"
)(
    lambda px: rounded(U.normalised(px, "risk", PX("pa"), 50))
)
query("split_by_target", W + "SELECT CAST(loss = 1 AS INT) AS event, count(*) AS n FROM l WHERE loss IS NOT NULL GROUP BY 1")(
    lambda px: (
        lambda e, f: e.agg(F.lit(1).alias("event"), F.count("*").alias("n")).union(f.agg(F.lit(0).alias("event"), F.count("*").alias("n")))
    )(*U.split_by_target(px, "loss"))
)
query("finite_pairs", "WITH " + E + " SELECT count(*) AS n, round(sum(value), 6) AS total FROM e WHERE iter % 4 > 0 AND iter % 5 > 0", trace)(
    lambda t: t.select(
        "value",
        F.when(PX("iter") % 4 > 0, PX("value")).alias("a"),
        F.when(PX("iter") % 5 == 0, float("inf")).otherwise(1.0).alias("b")
    ).filter(U.finite("a", "b")).agg(
        F.count("*").alias("n"),
        F.round(F.sum("value"), 6).alias("total")
    )
)
query(
    "common_axis",
    "WITH " + E + """, t AS (SELECT param, min(v) AS lo, max(v) AS hi FROM (SELECT param, CASE WHEN param = 'p1' THEN 3e0 WHEN param = 'p2' THEN 0e0 ELSE value END AS v FROM e) GROUP BY param)
SELECT param, CASE WHEN lo = hi AND lo = 0 THEN 0e0 WHEN lo = hi THEN lo - abs(lo) ELSE lo END AS low, CASE WHEN lo = hi AND lo = 0 THEN 1e0 WHEN lo = hi THEN hi + abs(hi) ELSE hi END AS high FROM t""",
    trace
)(
    lambda t: (
        lambda v: reduce(DataFrame.union, [U.axis_bounds(v(f"p{i}"), "v", "w").withColumn("param", F.lit(f"p{i}")) for i in range(7)])
    )(
        lambda p: t.filter(PX("param") == p).select(
            F.when(PX("param") == "p1", 3.0).when(PX("param") == "p2", 0.0).otherwise(PX("value")).alias("v"),
            F.lit(None).cast("double").alias("w")
        )
    )
)

# --- Sampling.

query(
    "sample_points",
    W + "SELECT CAST(NULL AS BIGINT) AS draw, forest_t1 AS strata, row, col, 500000e0 + (col + 0.5e0) * 30e0 AS x, 100000e0 - (row + 0.5e0) * 30e0 AS y FROM g WHERE forest_t1 IS NOT NULL AND row % 7 = 0 AND col % 7 = 0",
    both
)(
    lambda t: (
        lambda path: (
            IO.write_points(P.points(t[0], "forest_t1", t[1], "systematic", spacing=205.0), path),
            IO.read_points(t[0].sparkSession, path)
        )[1]
    )(folder(t[0], "points"))
)
query("sample_all", W + "SELECT row, col, loss AS strata FROM l WHERE loss IS NOT NULL", both)(
    lambda t: P.points(t[0], "loss", t[1], "random", n=10**9).select("row", "col", "strata")
)
query(
    "sample_classes",
    W + ", k AS (SELECT loss, count(*) AS n FROM l WHERE loss IS NOT NULL GROUP BY loss) SELECT loss AS strata, least(300, n) AS n FROM k",
    both
)(
    lambda t: P.sampled_classes(P.points(t[0], "loss", t[1], "stratified", n=600, seed=3))
)
query("sample_in_draw_order", source=both)(lambda t: P.in_draw_order(P.points(t[0], "loss", t[1], "stratified", n=600, allocation="proportional", seed=5)))
query("class_table", W + "SELECT CAST(risk AS BIGINT) AS strata, count(*) AS n FROM g GROUP BY risk")(
    lambda px: U.class_table(px.withColumn("risk", PX("risk").cast("double")), "risk")
)
query(
    "class_domain",
    W + "SELECT count(DISTINCT v) AS n_values, count(*) FILTER (WHERE v <> floor(v)) AS n_not_whole, false AS valid FROM (SELECT CASE WHEN risk % 9 = 2 THEN risk + 0.5e0 ELSE risk END AS v FROM g)"
)(
    lambda px: U.class_domain(px.select(F.when(PX("risk") % 9 == 2, PX("risk") + 0.5).otherwise(PX("risk")).alias("v")), "v")
)
query(
    "extract_at_points",
    W + """, q AS (SELECT 500000e0 + s_suppkey * 37 % 4700 - 100 AS x, 100000e0 - s_suppkey * 53 % 3100 + 50 AS y FROM supplier), z AS (SELECT max(row) AS last FROM g),
r AS (SELECT x, y, floor((100000e0 - y) / 30e0) AS row, floor((x - 500000e0) / 30e0) AS col, floor((100030e0 - y) / 90e0) AS r3, floor((x - 499910e0) / 90e0) AS c3 FROM q)
SELECT a.loss, b.elevation, CAST(r.row AS BIGINT) * 150 + CAST(r.col AS BIGINT) AS cell_id, 1 AS trial FROM r JOIN l a ON a.row = r.row AND a.col = r.col JOIN l b ON b.row = r.r3 AND b.col = r.c3 WHERE a.loss IS NOT NULL AND b.elevation IS NOT NULL""",
    lambda s, d: (pixels(s, d), grid(s, d), s.read.parquet(f"{d}/supplier.parquet"))
)(
    lambda t: P.extract_at(
        t[2].select((X0 + PX("s_suppkey") * 37 % 4700 - 100).alias("x"), (Y0 - PX("s_suppkey") * 53 % 3100 + 50).alias("y")),
        t[1],
        [(t[0], t[1], ["loss"]), (t[0], GridSpec("EPSG:32631", 499_910.0, 100_030.0, 90.0, 90.0, t[1].n_rows, WIDTH), ["elevation"])]
    )
)

# --- Derived layers.

query(
    "closest_epoch",
    "WITH " + K + ", e AS (SELECT unnest(range(1975, 2021, 5)) AS e) SELECT id, CAST(arg_min(e, abs(e - (year - 30)) * 10000 + e) AS INT) AS epoch FROM k, e GROUP BY id",
    catalog
)(
    lambda c: c.select("id", D.closest_epoch(PX("year") - 30).alias("epoch"))
)
query(
    "settlement_mask",
    W + "SELECT row, col, CAST(coalesce(forest_t1 * 20 >= 15 AND risk * 3 >= 90, false) AS INT) AS value FROM g"
)(
    lambda px: D.settled_at(
        px.select(
            "row",
            "col",
            F.explode(F.array(F.lit(2010), F.lit(2015), F.lit(2020))).alias("epoch"),
            "forest_t1",
            "risk"
        ).select(
            "row",
            "col",
            "epoch",
            (PX("forest_t1") * (2035 - PX("epoch"))).alias("population"),
            (PX("risk") * (PX("epoch") - 2012)).alias("built")
        ),
        2016
    )
)
query("water_mask", W + "SELECT row, col, CASE WHEN fcc >= 2 AND forest_t1 IS NOT NULL THEN 1 ELSE 0 END AS value FROM l")(
    lambda px: px.select("row", "col", D.water(F.when(PX("forest_t1").isNotNull(), PX("fcc"))).alias("value"))
)
query("undisturbed_forest", W + "SELECT row, col, CASE WHEN forest_t1 IS NOT NULL THEN CAST(subj % 6 = 1 AS INT) END AS value FROM g")(
    lambda px: px.select("row", "col", D.undisturbed(F.when(PX("forest_t1").isNotNull(), PX("subj") % 6)).alias("value"))
)
query("forest_at_year", W + "SELECT row, col, CASE WHEN subj > 5 AND subj < 15 THEN 0 ELSE CAST(risk * 2 >= 30 AS INT) END AS value FROM g")(
    lambda px: px.select("row", "col", L.cover_at(PX("risk") * 2, F.when(PX("subj") > 5, PX("subj")), 2015, 30).alias("value"))
)
query(
    "protected_mask",
    W + "SELECT row, col, CAST(row BETWEEN 1 AND 7 AND col % 30 BETWEEN 2 AND 17 AND floor(col / 30) NOT IN (1, 3) AS INT) AS value FROM g",
    lambda s, d: (pixels(s, d), grid(s, d), projects(s, d))
)(
    lambda t: D.protected(
        t[0],
        t[2].withColumn("status", F.when(PX("feature_id") % 2 == 0, "Designated").otherwise("Not Reported")),
        t[1].n_rows,
        X0,
        Y0,
        RES,
        WIDTH
    )
)
query(
    "distance_layer",
    W + """, z AS (SELECT row, col FROM g WHERE forest_t2 = 1) SELECT a.row, a.col, round(min(sqrt(pow(a.row - z.row, 2) + pow(a.col - z.col, 2))) * 30e0, 6) AS forest_t2_dist
FROM g a, z WHERE a.forest_t2 IS NOT NULL GROUP BY a.row, a.col"""
)(
    lambda px: rounded(D.distance_layer(px, "forest_t2", "dist", RES), 6)
)
query(
    "climate_year",
    "SELECT user_id, CAST(round(sum(value) * 1000) AS INT) AS total, CAST(round(avg(value) - 273.15e0) AS INT) AS mean, CAST(round(max(value) - 273.15e0) AS INT) AS high, CAST(round(min(value) - 273.15e0) AS INT) AS low, CAST(round(quantile_cont(CAST(value AS DOUBLE), 0.5) - 273.15e0) AS INT) AS median FROM events GROUP BY user_id",
    lambda s, d: s.read.parquet(f"{d}/events.parquet")
)(
    lambda e: D.year_of_climate(e, "value", ("user_id",))
)
query("layer_stack", W + "SELECT row, col, loss, risk FROM l WHERE risk > 10")(
    lambda px: stack(
        ("loss", px.select("row", "col", PX("loss").alias("value"))),
        ("risk", px.filter("risk > 10").select("row", "col", PX("risk").alias("value")))
    )
)
query(
    "rasterize_unique",
    W + "SELECT row, col, CAST(floor(col / 30) + 1 AS INT) AS value FROM g WHERE row BETWEEN 1 AND 7 AND col % 30 BETWEEN 2 AND 17 AND row < (SELECT max(row) + 1 FROM g)",
    lambda s, d: (grid(s, d), projects(s, d))
)(
    lambda t: IO.rasterize(polygon_file(t[1]), t[0].n_rows, X0, Y0, RES, WIDTH, unique=True)
)


def polygon_file(shapes: DataFrame) -> DataFrame:
    """The shapes written as GeoJSON, and read back (their ids count from 1)."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(PX("feature_id").alias("id")).alias("properties"), F.struct("kind", "rings").alias("g"))
    text = shapes.orderBy("feature_id").select(feature.alias("f")).select(
        F.struct("f.type", "f.properties", F.struct(PX("f.g.kind").alias("type"), PX("f.g.rings").alias("coordinates")).alias("geometry")).alias("f")
    )
    one = text.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.sort_array(F.collect_list("f")).alias("features"))).alias("value"))
    path = folder(shapes, "shapes")
    one.write.text(path)
    return IO.read_polygons(shapes.sparkSession, path)


# --- Sinks, read back.


def through_csv(df: DataFrame, kind: str, schema: str | None = None) -> DataFrame:
    path = folder(df, kind)
    IO.write_csv(df, path, None if schema else kind)
    return IO.read_csv(df.sparkSession, path, schema or kind)


query("rate_table_csv", SQL["defrate_per_cat"])(lambda px: rounded(through_csv(rounded(R.defrate_per_cat(px, YEARS, AREA)), "rates")))
query("distance_table_csv", SQL["tab_distance"])(
    lambda px: rounded(through_csv(rounded(R.distance_table(px, "edge", "loss", RES, 5000.0, AREA), 8), "distances"), 8)
)
query("point_table_csv", "SELECT cell, nfor_obs_ha, ndefor_obs_ha, ndefor_pred_ha FROM (" + SQL["cell_tally"] + ")")(
    lambda px: rounded(through_csv(rounded(R.cell_tally(px, R.defrate_per_cat(px, YEARS, AREA), WIDTH, 25, YEARS, AREA), 8), "points"), 8)
)
query(
    "allocation_csv",
    "SELECT period, length AS \"length (yr)\", round(deforestation, 1) AS \"deforestation (ha)\" FROM (" + SQL["allocate"] + ")",
    lambda s, d: (pixels(s, d), grid(s, d), projects(s, d))
)(
    lambda t: through_csv(WF.allocate(t[0], R.defrate_per_cat(t[0], YEARS, AREA), t[2], 1000.0, 4, t[1], mask=1 - PX("pa")), "allocation")
)
query(
    "indices_csv",
    SQL["indices_all"].replace(
        "SELECT prediction, csize",
        "SELECT prediction, 'GLM' AS model, 'p' AS period, 't' AS truth, csize AS csize_coarse_grid, round(csize * csize * 0.09e0, 2) AS csize_coarse_grid_ha"
    ).replace(', 8) AS "', ', 6) AS "')
)(
    lambda px: rounded(
        through_csv(
            EV.evaluated(px, {"a": PX("risk"), "b": 51 - PX("risk")}, [10, 25, 50], WIDTH, YEARS, AREA).select(
                "*",
                F.lit("GLM").alias("model"),
                F.lit("p").alias("period"),
                F.lit("t").alias("truth"),
                PX("csize").alias("csize_coarse_grid"),
                F.round(PX("csize") * PX("csize") * 0.09, 2).alias("csize_coarse_grid_ha")
            ),
            "indices"
        ),
        6
    )
)
query("training_csv", SQL["extract_points"].replace("SELECT elevation", "SELECT round(elevation, 6) AS elevation"))(
    lambda px: rounded(
        through_csv(
            P.extract(P.systematic(px, 5, 5), px, ["elevation", "pa", "loss"], WIDTH),
            "training",
            "elevation double, pa int, loss int, cell_id long, trial int"
        ),
        6
    )
)


query("forecast_rates_csv", PER_CAT + """, x AS (SELECT sum(nfor * rate_mod) AS e FROM s)
SELECT cat, nfor, round(rate_mod, 10) AS rate_mod, 0.09e0 AS pixel_area, round(rate_mod * 1000e0 / (0.09e0 * e), 10) AS rate_abs, round(rate_mod * 1000e0 / e / 4, 10) AS defor_dens FROM s, x""")(
    lambda px: rounded(through_csv(R.forecast_rates(R.defrate_per_cat(px, YEARS, AREA), 1000.0, 4), "forecast_rates"))
)


def exported(px: DataFrame) -> DataFrame:
    paths = IO.export_layers(px, ["loss", "pa"], folder(px, "layers"), "x_", "_30m")
    parts = [IO.read_layer(px.sparkSession, path, "int").withColumn("layer", F.lit(n)) for path, n in zip(paths, ("loss", "pa"), strict=True)]
    return parts[0].union(parts[1])


query("exported_layers", W + "SELECT row, col, loss AS value, 'loss' AS layer FROM l UNION ALL SELECT row, col, pa, 'pa' FROM l")(exported)

# --- The layer catalog.



def harmonised(c: DataFrame) -> DataFrame:
    """Status of layers whose outputs differ by what the supplier's number says."""
    once = c.groupBy("name", "year").agg(F.min("id").alias("id"))
    raw = once.select(
        "name",
        "year",
        F.when(PX("id") % 5 == 0, "vector").otherwise("raster").alias("data_type"),
        F.lit("continuous").alias("raster_type"),
        F.lit("binary").alias("method"),
        (PX("id") % 10 != 0).alias("active"),
        F.lit(10).alias("modified_at")
    )
    out = once.filter("id % 3 <> 0").select(
        "name", "year", F.when(PX("id") % 7 == 0, "categorical").otherwise("continuous").alias("raster_type"), F.lit(None).cast("array<double>").alias("levels"),
        F.when(PX("id") % 11 == 0, F.lit(None)).when(PX("id") % 11 == 1, "old").otherwise("g").alias("grid_signature"), F.concat(F.lit("/p/"), F.when(PX("id") % 13 == 0, 0).otherwise(PX("id")).cast("string")).alias("path"), (PX("id") % 4 + 8).alias("modified_at"))
    return C.harmonisation(raw, out, "g")


query(
    "harmonisation_status",
    "WITH " + K + """, o AS (SELECT name, year, min(id) AS id FROM k GROUP BY name, year), a AS (SELECT * FROM o WHERE NOT (id % 5 = 0 AND id % 10 = 0)),
s AS (SELECT count(*) FILTER (WHERE id % 13 = 0 AND id % 3 <> 0) AS n FROM a)
SELECT name || '_' || CAST(year AS VARCHAR) AS key, CASE WHEN id % 3 = 0 THEN 'pending' WHEN id % 11 = 0 THEN 'unknown' WHEN id % 7 = 0 OR id % 4 + 8 < 10 OR (id % 13 = 0 AND n > 1) OR id % 11 = 1 THEN 'pending' ELSE 'current' END AS status FROM a, s""",
    catalog
)(harmonised)
query("layers_without_levels", "WITH " + K + " SELECT DISTINCT name FROM k WHERE id % 4 = 1", catalog)(
    lambda c: C.without_levels(
        c.select(
            "name",
            F.when(PX("id") % 2 == 1, "categorical").otherwise("continuous").alias("raster_type"),
            F.when(PX("id") % 4 != 1, F.array(F.lit(1.0))).alias("levels")
        )
    )
)
query("export_nodata", "WITH " + K + " SELECT id, CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN -32768 ELSE 255 END AS nodata FROM k", catalog)(
    lambda c: c.select("id", C.export_nodata(F.when(PX("id") % 3 == 0, 7), F.when(PX("id") % 3 == 1, "continuous").otherwise("categorical")).alias("nodata"))
)
query("change_candidates", "WITH " + K + " SELECT id FROM k WHERE id % 4 <> 0 AND id % 3 <> 0", catalog)(
    lambda c: C.change_candidates(
        c.select(
            "id",
            F.when(PX("id") % 4 == 0, "vector").otherwise("raster").alias("data_type"),
            F.when(PX("id") % 3 != 0, PX("year")).alias("year")
        )
    ).select("id")
)


def change_run(px: DataFrame) -> DataFrame:
    rows = [("forest", 2015, "raster", "g", "forest_t1"), ("forest", 2020, "raster", "g", "forest_t2"), ("other", 2024, "raster", "g", "forest_t3")]
    layers = px.sparkSession.createDataFrame(rows, "name string, year int, data_type string, grid_signature string, path string")
    name, out = WF.change_layer(layers, "gain", "forest_2020", "other_2024", lambda p: px.select("row", "col", PX(p).alias("value")))
    return out.withColumn("name", F.lit(name))


query(
    "change_by_keys",
    W + "SELECT row, col, CASE WHEN forest_t2 = 0 AND forest_t3 = 1 THEN 1 WHEN forest_t2 = 0 AND forest_t3 = 0 THEN 0 END AS value, 'gain_forest_2020_other_2024' AS name FROM g"
)(change_run)
ROLES = "WITH " + K + ", f AS (SELECT id AS position, year AS dataset, CASE WHEN id % 3 = 0 THEN 'forest_gfc' WHEN id % 3 = 1 THEN 'forest_gfc_tc' || CAST(id AS VARCHAR) ELSE 'slope' END AS name FROM k) "
_roles = lambda c: c.select(PX("id").alias("position"), PX("year").alias("dataset"), F.when(PX("id") % 3 == 0, "forest_gfc").when(PX("id") % 3 == 1, F.concat(F.lit("forest_gfc_tc"), PX("id").cast("string"))).otherwise("slope").alias("name"))
query("first_role_layer", ROLES + "SELECT dataset, arg_min(name, position) AS layer FROM f WHERE name <> 'slope' GROUP BY dataset", catalog)(
    lambda c: C.named_layer(_roles(c), "forest_gfc")
)
query(
    "sole_role_layer",
    ROLES + "SELECT dataset, CASE WHEN count(*) = 1 THEN min(name) END AS layer FROM f WHERE name <> 'slope' GROUP BY dataset",
    catalog
)(
    lambda c: C.sole_layer(_roles(c), "forest_gfc")
)
query(
    "role_files",
    "WITH " + K + """, f AS (SELECT '/d/' || CASE id % 4 WHEN 0 THEN 'Altitude_' || id WHEN 1 THEN 'gfc_forest_' || year || '_reprojected_edge' WHEN 2 THEN 'gfc_forest_loss_' || year || '_' || (year + 5) ELSE 'town_' || year || '_reprojected_distance' END || '.tif' AS path, year FROM k),
y AS (SELECT DISTINCT year FROM k) SELECT CAST(y.year AS VARCHAR) AS name, (SELECT min(path) FROM f WHERE path LIKE '%Altitude%') AS altitude, (SELECT min(path) FROM f WHERE f.year = y.year AND path LIKE '%edge%') AS dist_edge,
(SELECT min(path) FROM f WHERE f.year = y.year AND path LIKE '%loss%') AS fcc, (SELECT min(path) FROM f WHERE f.year = y.year AND path LIKE '%town%') AS dist_town FROM y WHERE EXISTS (SELECT 1 FROM f WHERE path LIKE '%Altitude%')""",
    catalog
)(
    lambda c: C.role_files(
        c.select(
            F.concat(
                F.lit("/d/"),
                F.when(PX("id") % 4 == 0, F.concat(F.lit("Altitude_"), "id")).when(
                    PX("id") % 4 == 1,
                    F.concat(F.lit("gfc_forest_"), "year", F.lit("_reprojected_edge"))
                ).when(
                    PX("id") % 4 == 2,
                    F.concat(F.lit("gfc_forest_loss_"), "year", F.lit("_"), PX("year") + 5)
                ).otherwise(
                    F.concat(F.lit("town_"), "year", F.lit("_reprojected_distance"))
                ),
                F.lit(".tif")
            ).alias("path")
        ),
        c.select("year").distinct().select(
            PX("year").cast("string").alias("name"),
            F.lit("calibration").alias("period"),
            PX("year").alias("initial_year"),
            (PX("year") + 5).alias("final_year")
        ),
        "gfc",
    ).select(
        "name",
        *[PX("files")[r].alias(r) for r in ("altitude", "dist_edge", "fcc", "dist_town")]
    )
)


def dataset(c: DataFrame) -> DataFrame:
    """Target and features resolved by name and year, on the years that the catalog has."""
    t = c.select(
        F.concat(F.lit("v"), (PX("id") % 3).cast("string")).alias("name"),
        F.when(PX("id") % 3 == 2, F.lit(None)).otherwise(PX("year")).cast("int").alias("year"),
        F.concat(
            F.lit("/v/"),
            (PX("id") % 3).cast("string"),
            F.coalesce(F.when(PX("id") % 3 != 2, PX("year").cast("string")), F.lit(""))
        ).alias("path")
    )
    last = t.filter("name = 'v0'").agg(F.max("year")).first()[0]
    first = t.filter("name = 'v1'").agg(F.min("year")).first()[0]
    return C.resolve(t, ("v0", last), ["v1", "v2"], {"v1": first})


query(
    "dataset_layers",
    "WITH " + K + """ SELECT 'target' AS role, 0 AS position, 'v0' AS name, max(year) AS year, '/v/0' || CAST(max(year) AS VARCHAR) AS path FROM k WHERE id % 3 = 0
UNION ALL SELECT 'feature', 1, 'v1', min(year), '/v/1' || CAST(min(year) AS VARCHAR) FROM k WHERE id % 3 = 1 UNION ALL SELECT 'feature', 2, 'v2', NULL, '/v/2'""",
    catalog
)(dataset)
query("catalog_all_years", "WITH " + K + " SELECT DISTINCT year FROM k WHERE id % 4 > 0", catalog)(
    lambda c: C.all_years(c.withColumn("year", F.when(PX("id") % 4 > 0, PX("year"))))
)


def harmonise_run(px: DataFrame) -> DataFrame:
    """Two layers of a coarser grid are put on the stack's; a third is current."""
    spark, at = px.sparkSession, folder(px, "harmonised")
    raw = spark.createDataFrame(
        [(n, None, "raster", k, None, True, 5) for n, k in (("elevation", "continuous"), ("risk", "categorical"), ("pa", "continuous"))],
        "name string, year int, data_type string, raster_type string, method string, active boolean, modified_at int"
    )
    out = spark.createDataFrame(
        [("pa", None, "continuous", None, "g", "/pa", 9), ("risk", None, "categorical", None, "g", "/risk", 9)],
        "name string, year int, raster_type string, levels array<double>, grid_signature string, path string, modified_at int"
    )
    run = lambda key: (RS.regrid(px, px, key, 4.0, bilinear=key == "elevation").withColumnRenamed(key, "value"), f"{at}/{key}")
    done = WF.harmonise(raw, out, "g", run, lambda path, layer: IO.write_layer(layer, path))
    parts = [IO.read_layer(spark, f"{at}/{key}").withColumn("layer", F.lit(key)) for key in done]
    return rounded(parts[0].unionByName(parts[1]), 8)


query(
    "harmonise_layers",
    "SELECT row, col, elevation AS value, 'elevation' AS layer FROM (" + SQL[
        "regrid_bilinear"
    ]+ ") UNION ALL SELECT * FROM (" + W + "SELECT t.row, t.col, CAST(g.risk AS DOUBLE) AS value, 'risk' AS layer FROM g t LEFT JOIN g ON g.row = floor((t.row + 0.5e0) / 4e0) AND g.col = floor((t.col + 0.5e0) / 4e0))"
)(harmonise_run)
query(
    "prediction_groups",
    "WITH " + K + """ SELECT row_key, list_sort(list(sk)) AS storage_keys FROM (SELECT CASE WHEN id % 3 = 0 THEN name ELSE 'm' || CAST(id % 4 AS VARCHAR) || '__' || name END AS row_key,
'm' || CAST(id % 4 AS VARCHAR) || '__' || name || CASE WHEN id % 2 = 0 THEN '_y' || CAST(year AS VARCHAR) ELSE '' END || CASE WHEN id % 5 = 0 THEN '_w' || CAST(id AS VARCHAR) ELSE '' END AS sk FROM k) GROUP BY row_key""",
    catalog
)(
    lambda c: C.grouped_predictions(
        c.select(
            F.when(PX("id") % 3 == 0, PX("name")).alias("name"),
            F.concat(F.lit("m"), (PX("id") % 4).cast("string")).alias("model"),
            PX("name").alias("dataset"),
            F.when(PX("id") % 2 == 0, PX("year")).alias("year"),
            F.when(PX("id") % 5 == 0, PX("id")).alias("window")
        )
    )
)

# --- Names and numbers.

query("name_interval", "WITH " + K + " SELECT id, CASE WHEN id % 4 > 0 THEN CAST(id % 6 AS INT) END AS years FROM k", catalog)(
    lambda c: c.select(
        "id",
        NA.years_in(
            F.concat(
                PX("name"),
                F.lit("_loss_"),
                PX("year").cast("string"),
                F.when(PX("id") % 4 > 0, F.concat(F.lit("_"), (PX("year") + PX("id") % 6).cast("int").cast("string"))).otherwise("")
            )
        ).alias("years")
    )
)
FAMILY = "['MW', 'GLM', 'RF', 'ICAR', 'JNR', 'xgb_' || CAST(id AS VARCHAR)][id % 6 + 1]"


def model_key() -> Column:
    return F.concat(F.array(*map(F.lit, ("mw", "glm", "rf", "icar", "jnr", "xgb")))[(PX("id") % 6).cast("int")], F.lit("_"), PX("id").cast("string"))


query("shown_labels", "WITH " + K + f" SELECT id, {FAMILY} || CASE WHEN id % 6 = 0 THEN '_w5' ELSE '' END || ' · ' || name AS label FROM k", catalog)(
    lambda c: c.select("id", NA.shown_label(model_key(), F.when(PX("id") % 6 == 0, 5), PX("name")).alias("label"))
)
query(
    "design_terms",
    "SELECT DISTINCT n_nationkey AS level, 'subj' AS variable, CAST(n_nationkey AS VARCHAR) AS shown, '0' AS reference FROM nation",
    lambda s, d: s.read.parquet(f"{d}/nation.parquet")
)(
    lambda n: n.select(
        PX("n_nationkey").alias("level"),
        F.concat(F.lit("C(subj, levels=[0, 1, 2])[T."), PX("n_nationkey").cast("string"), F.lit("]")).alias("t")
    ).select(
        "level",
        NA.term_variable(PX("t")).alias("variable"),
        NA.term_level(PX("t")).alias("shown"),
        NA.reference_level(PX("t")).alias("reference")
    )
)
query(
    "change_files",
    "WITH " + K + " SELECT id, '/data/nation_loss_' || split_part(name, '_', 2) || '_' || CAST(year AS VARCHAR) || CAST(year + 5 AS VARCHAR) || '.tif' AS change, '/data/nation_stack_' || split_part(name, '_', 2) || '_' || CAST(year AS VARCHAR) || '_' || CAST(year + 5 AS VARCHAR) || '_' || CAST(year + 9 AS VARCHAR) || '.tif' AS stack FROM k",
    catalog
)(
    lambda c: (
        lambda at: c.select("id", NA.change_file(at(5), at(0), "loss").alias("change"), NA.stack_file(at(0), at(5), at(9), "stack").alias("stack"))
    )(
        lambda n: F.concat(F.lit("/data/nation_x_"), F.split("name", "_")[1], F.lit("_"), (PX("year") + n).cast("string"), F.lit(".tif"))
    )
)
query(
    "change_names",
    "WITH " + K + " SELECT id, CASE WHEN id % 3 > 0 THEN 'loss_' || name || '_' || CAST(year AS VARCHAR) || CASE WHEN id % 2 = 0 THEN '' ELSE '_b' END || '_' || CAST(year + id % 3 AS VARCHAR) END AS name FROM k",
    catalog
)(
    lambda c: c.select(
        "id",
        NA.change_name(
            F.lit("loss"),
            PX("name"),
            PX("year"),
            F.when(PX("id") % 2 == 0, PX("name")).otherwise("b"),
            (PX("year") + PX("id") % 3)
        ).alias("name")
    )
)
query(
    "storage_keys",
    "WITH " + K + " SELECT id, 'm__' || name || '_y' || CAST(year AS VARCHAR) AS prediction, 't__' || CAST(year AS VARCHAR) || '0102030405_' || CAST(id AS VARCHAR) AS evaluation FROM k",
    catalog
)(
    lambda c: c.select(
        "id",
        NA.prediction_key(F.lit("m"), PX("name"), PX("year"), F.lit(None).cast("int")).alias("prediction"),
        NA.evaluation_key(F.lit("t"), F.concat(PX("year").cast("string"), F.lit("-01-02T03:04:05")), PX("id").cast("string")).alias("evaluation")
    )
)
query(
    "cell_sizes",
    "WITH " + K + " SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN [CAST(id AS INT), 300] ELSE [CAST(id AS INT)] END AS sizes FROM k",
    catalog
)(
    lambda c: c.select(
        "id",
        NA.cell_sizes(
            F.when(PX("id") % 4 == 0, "100, x").when(
                PX("id") % 4 == 1,
                F.concat(PX("id").cast("string"), F.lit(", 300  "), PX("id").cast("string"))
            ).otherwise(PX("id").cast("string"))
        ).alias("sizes")
    )
)
query(
    "file_models",
    "WITH " + K + " SELECT id, 'validation' AS period, CASE WHEN id % 2 = 0 THEN 'mw_' || name ELSE 'glm' END AS model, 'sys' AS system, CASE WHEN id % 2 = 0 THEN 'historical' END AS folder FROM k",
    catalog
)(
    lambda c: c.select(
        "id",
        F.when(PX("id") % 2 == 0, F.concat(F.lit("/r/test/sys/historical/indices_mw_"), PX("name"), F.lit("_validation_300.csv"))).otherwise(
            "/r/test/sys/x/indices_glm_validation.csv"
        ).alias("p")
    ).select(
        "id",
        NA.model_and_period(PX("p"))["period"].alias("period"),
        NA.model_and_period(PX("p"))["model"].alias("model"),
        NA.system_of(PX("p")).alias("system"),
        NA.period_of(PX("p")).alias("folder")
    )
)
query(
    "design_labels",
    "WITH " + K + " SELECT id, CASE id % 4 WHEN 0 THEN 'stratified, equal (' || name || ')' WHEN 1 THEN 'random' WHEN 2 THEN ' (' || name || ')' END AS label FROM k",
    catalog
)(
    lambda c: c.select(
        "id",
        NA.design_label(
            F.when(PX("id") % 4 == 0, "stratified").when(PX("id") % 4 == 1, "random"),
            F.when(PX("id") % 4 == 0, "equal"),
            F.when((PX("id") % 4).isin(0, 2), PX("name"))
        ).alias("label")
    )
)
LON, LAT = "(c_custkey * 37 % 3601) / 10e0 - 180", "(c_custkey * 53 % 1801) / 10e0 - 90"
query("utm_zones", f"""WITH q AS (SELECT c_custkey AS id, {LON} AS lon, {LAT} AS lat FROM customer),
z AS (SELECT *, CASE WHEN lat > 55 AND lat < 64 AND lon > 2 AND lon < 6 THEN 32 WHEN lat > 71 AND lon >= 6 AND lon < 9 THEN 31 WHEN lat > 71 AND ((lon >= 9 AND lon < 12) OR (lon >= 18 AND lon < 21)) THEN 33
  WHEN lat > 71 AND ((lon >= 21 AND lon < 24) OR (lon >= 30 AND lon < 33)) THEN 35 ELSE CAST(floor((lon + 180) / 6) AS INT) + 1 END AS zone FROM q)
SELECT id, CASE WHEN lat >= 84 THEN 5041 WHEN lat <= -80 THEN 5042 WHEN lat >= 0 THEN 32600 + zone ELSE 32700 + zone END AS epsg FROM z""", lambda s, d: s.read.parquet(f"{d}/customer.parquet"))(
    lambda c: c.select(PX("c_custkey").alias("id"), S.utm_epsg((PX("c_custkey") * 37 % 3601) / 10 - 180, (PX("c_custkey") * 53 % 1801) / 10 - 90).alias("epsg"))
)
query(
    "distance_edges",
    W + "SELECT risk, i, round(CASE WHEN i = 0 THEN 30e0 ELSE (risk * 100 + 60) * pow(30e0 / (risk * 100 + 60), (29 - i) / 29e0) END, 8) AS edge FROM (SELECT DISTINCT risk FROM g), (SELECT CAST(unnest(range(0, 30)) AS INT) AS i)"
)(
    lambda px: px.select("risk").distinct().select(
        "risk",
        F.explode(S.edge_table(F.lit(30.0), (PX("risk") * 100 + 60).cast("double"))).alias("e")
    ).select(
        "risk",
        PX("e.i").alias("i"),
        F.round("e.edge", 8).alias("edge")
    )
)
query("odds_ratios", "WITH " + E + " SELECT iter, CASE WHEN iter % 3 > 0 THEN round(exp(value / 100), 8) END AS odds FROM e", trace)(
    lambda t: t.select("iter", F.round(S.odds_ratio(F.when(PX("iter") % 3 > 0, PX("value") / 100).otherwise(1000.0)), 8).alias("odds"))
)
query(
    "pixel_places",
    W + "SELECT row, col, CAST(row AS BIGINT) * 150 + col AS id, 500000e0 + (col + 0.5e0) * 30e0 AS x, 100000e0 - (row + 0.5e0) * 30e0 AS y, row AS row2, col AS col2, 0.09e0 AS ha FROM g",
    both
)(
    lambda t: (
        lambda x, y: t[0].select(
            "row",
            "col",
            t[1].flat_id(PX("row"), PX("col")).alias("id"),
            x.alias("x"),
            y.alias("y"),
            t[1].pixel(x, y)[0].alias("row2"),
            t[1].pixel(x, y)[1].alias("col2"),
            F.lit(t[1].pixel_area_ha()).alias("ha")
        )
    )(*t[1].centre(PX("row"), PX("col")))
)
query("hectares", W + "SELECT subj, round(count(*) * 0.09e0, 8) AS ha FROM g GROUP BY subj", both)(
    lambda t: t[0].groupBy("subj").agg(F.round(S.hectares(F.count("*"), t[1].pixel_area_ha()), 8).alias("ha"))
)
query(
    "cells_in_km",
    W + "SELECT row, col, CAST(floor((row + 0.5e0) * 30e0 / 700e0) AS BIGINT) * 7 + CAST(floor((col + 0.5e0) * 30e0 / 700e0) AS BIGINT) AS cell FROM g",
    both
)(
    lambda t: t[0].select("row", "col", N.cell_index_km(t[1].flat_id(PX("row"), PX("col")), 0.7, RES, WIDTH).alias("cell"))
)
query("grid_signatures", W + "SELECT 'EPSG:32631|500000.0,100000.0,30.0,30.0|' || CAST(max(row) + 1 AS VARCHAR) || 'x150' AS signature FROM g", both)(
    lambda t: t[0].sparkSession.createDataFrame([(t[1].signature(),)], "signature string")
)
query("touched_pixels", W + f"SELECT row, col FROM g WHERE {INSIDE}", lambda s, d: (grid(s, d), projects(s, d)))(
    lambda t: GEO.touched(t[1], t[0].n_rows, X0, Y0, RES, WIDTH)
)
query(
    "null_deviance",
    W + "SELECT round(-2 * count(*) * (avg(loss) * ln(avg(loss)) + (1 - avg(loss)) * ln(1 - avg(loss))), 6) AS null_deviance FROM l WHERE loss IS NOT NULL"
)(
    lambda px: T.deviance(px.filter("loss IS NOT NULL").select(PX("loss").alias("y"), F.lit(0.5).alias("p")), "y", "p").select(
        F.round("null_deviance", 6).alias("null_deviance")
    )
)
