"""Queries of draws and fits by what must hold of any right result: SQL finds the same numbers without drawing or fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.scalars import logistic
from pixelweave.operators import bagging as B
from pixelweave.operators import models as M
from pixelweave.operators import neighborhood as N
from pixelweave.operators import sampling as P
from pixelweave.plans import raster
from pixelweave.plans.flows import both
from pixelweave.plans.queries import FEATURES, forest, scaled, spatial, split_rows
from pixelweave.plans.tables import PX, W, WIDTH, query
from pixelweave.sources.shared import written

KNOWN = W + ", q AS (SELECT row, col, loss FROM l WHERE loss IS NOT NULL) "


def valid(px: DataFrame) -> DataFrame:
    return px.filter("loss IS NOT NULL").select("row", "col", "loss")


def drawn(points: DataFrame, px: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per ``by``: points, different places, places of valid pixels with the same value, and whether the draws are 0, 1, 2, ..."""
    real = valid(px).withColumnRenamed("loss", "_real")
    t = written(points).join(real, ["row", "col"], "left")
    n = F.count("*")
    return t.groupBy(*by).agg(
        n.alias("n"),
        F.count_distinct("row", "col").alias("places"),
        F.count_if(F.col("_real") == F.col("loss")).alias("valid"),
        ((F.sum("draw") == n * (n - 1) / 2) & (F.count_distinct("draw") == n)).alias("in_turn"),
    )


query("random_points_hold", KNOWN + "SELECT least(500, count(*)) AS n, least(500, count(*)) AS places, least(500, count(*)) AS valid, true AS in_turn FROM q")(
    lambda px: drawn(P.random_points(valid(px), 500, 1), px)
)
query(
    "stratified_points_hold",
    KNOWN + "SELECT loss, n, n AS places, n AS valid, true AS in_turn FROM (SELECT loss, least(CASE loss WHEN 0 THEN 300 ELSE 200 END, count(*)) AS n FROM q GROUP BY loss)",
)(lambda px: drawn(P.stratified_points(valid(px), "loss", {0: 300, 1: 200}, 1), px, ("loss",)))


def draw_order(px: DataFrame, grid) -> DataFrame:
    """The place of each class in the order: events from 0, then the others, each by its draws."""
    points = written(P.points(px, "loss", grid, "stratified", n=600, allocation="proportional", seed=5))
    rows = P.in_draw_order(points).coalesce(1).withColumn("at", F.monotonically_increasing_id())  # a few hundred rows
    turn = F.row_number().over(Window.partitionBy("strata").orderBy("draw")) - 1
    t = rows.withColumn("turn", turn)
    return t.groupBy("strata").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(PX("at") - PX("turn") != 0).alias("shifted"))


query(
    "draw_order_holds",
    KNOWN + """, k AS (SELECT loss, count(*) AS n FROM q GROUP BY loss), a AS (SELECT loss, CAST(least(round_even(600e0 * n / (SELECT sum(n) FROM k), 0), n) AS BIGINT) AS m FROM k),
e AS (SELECT coalesce(sum(m) FILTER (WHERE loss = 1), 0) AS events FROM a)
SELECT loss AS strata, m AS n, CASE loss WHEN 1 THEN 0 ELSE CAST(events AS BIGINT) END AS first, CASE loss WHEN 1 THEN 0 ELSE CAST(events AS BIGINT) END + m - 1 AS last, CASE loss WHEN 1 THEN 0 ELSE m END AS shifted FROM a, e WHERE m > 0""",
    both,
)(lambda t: draw_order(*t))


def predictor(beta: dict[str, float]) -> Column:
    return sum((PX(f) * float(beta[f]) for f in FEATURES), F.lit(float(beta["Intercept"])))


def glm_gradient(px: DataFrame) -> DataFrame:
    """Slope of the penalised likelihood at the estimates, a term: none is left at the maximum."""
    t = scaled(px).filter("loss IS NOT NULL")
    beta = {r["term"]: r["estimate"] for r in M.glm_fit(t, "loss", FEATURES).collect()}  # a row a term
    rest = PX("loss") - logistic(predictor(beta))
    slopes = [F.sum(rest).alias("Intercept"), *[(F.sum(rest * PX(f)) - F.lit(beta[f])).alias(f) for f in FEATURES]]
    one = t.agg(*slopes, F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(n).alias("term"), (F.abs(n) < 1e-4 * PX("n")).alias("flat")) for n in ("Intercept", *FEATURES)])
    return one.select("n", F.explode(each).alias("r")).select("r.*", "n")


FLAT = KNOWN + "SELECT term, true AS flat, (SELECT count(*) FROM q) AS n FROM (VALUES {terms}) t(term)"
query("glm_fit_is_a_maximum", FLAT.format(terms=", ".join(f"('{n}')" for n in ("Intercept", *FEATURES))))(glm_gradient)


def forest_bounds(scored: DataFrame, loss: str = "loss") -> DataFrame:
    """Pixels, chances out of bounds, and whether events get higher chances than the others."""
    mean = lambda v: F.avg(F.when(F.col(loss) == v, F.col("p")))
    return scored.agg(F.count("*").alias("n"), F.count_if((PX("p") < 0) | (PX("p") > 1) | PX("p").isNull()).alias("outside"), (mean(1) > mean(0)).alias("tells_apart"))


BOUNDS = W + "SELECT count(*) AS n, 0 AS outside, true AS tells_apart FROM l"
query("forest_apply_holds", BOUNDS)(lambda px: forest_bounds(M.forest_apply(forest(px), scaled(px), FEATURES, ("loss",))))
query("bagged_forest_holds", BOUNDS)(lambda px: forest_bounds(B.forest_apply(raster.forest(px)[0], scaled(px), ("loss",))))


def out_of_bag_bound(px: DataFrame) -> DataFrame:
    """The out-of-bag accuracy is that of unseen rows: within three hundredths of the held-out pixels'."""
    fitted, fitting = raster.forest(px)
    seen = B.forest_statistics(fitted, fitting, "loss").first()
    rest = M.accuracy_of(B.forest_apply(fitted, split_rows(scaled(px))[1], ("loss",)), "loss", "p").first()
    near, whole = abs(seen["oob_accuracy"] - rest["accuracy"]) < 0.03, seen["n_rows"] + rest["n"]
    return px.sparkSession.createDataFrame([(whole, near, seen["n_scored"] >= 0.99 * seen["n_rows"])], "n long, near boolean, most_scored boolean")


query("out_of_bag_holds", KNOWN + "SELECT count(*) AS n, true AS near, true AS most_scored FROM q")(out_of_bag_bound)


def spatial_balance(px: DataFrame) -> DataFrame:
    """Cells of the effect, whether it is centred, and whether cells with more loss than their neighbours lie higher."""
    rho = written(spatial(px))
    cell = N.cell_index(PX("row"), PX("col"), 25, WIDTH).alias("cell")
    rates = px.filter("loss IS NOT NULL").groupBy(cell).agg(F.avg("loss").alias("rate"))
    t = rho.join(rates, "cell", "left")
    return t.agg(F.count("*").alias("cells"), (F.abs(F.sum("rho")) < 1e-6 * F.count("*")).alias("centred"), (F.corr("rho", "rate") > 0.3).alias("follows"))


query("spatial_fit_holds", KNOWN + "SELECT count(DISTINCT row // 25 * 6 + col // 25) AS cells, true AS centred, true AS follows FROM q")(spatial_balance)


def interval_order(px: DataFrame) -> DataFrame:
    t = raster.spatial_coefficients(px)
    return t.select("term", ((PX("std") > 0) & (PX("ci_low") < PX("estimate")) & (PX("estimate") < PX("ci_high"))).alias("in_order"))


query("spatial_intervals_hold", "SELECT term, true AS in_order FROM (VALUES " + ", ".join(f"('{n}')" for n in ("Intercept", *FEATURES)) + ") t(term)")(interval_order)
