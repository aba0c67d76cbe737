"""Fitting the event models: logistic regression, forest of trees, logistic regression with a spatial effect per cell.

Rows with NULL in the target or a feature take no part in a fit. A target of one class only raises ValueError.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.scalars import logistic
from pixelweave.operators.rates import with_totals
from pixelweave.operators.resample import regrid
from pixelweave.sources.shared import discard, written


def training(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """``(_y double, _x vector)`` of the complete rows."""
    t = df.select(F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    return VectorAssembler(inputCols=features, outputCol="_x").transform(t).select("_y", "_x")


def _class_totals(t: DataFrame, y: str = "_y") -> tuple[int, float]:
    n, events = t.agg(F.count("*"), F.sum(y)).first()
    if not n or events in (0, n):
        raise ValueError("the target needs rows of both classes")
    return n, events


def glm_fit(df: DataFrame, target: str, features: list[str], max_iter: int = 1000) -> DataFrame:
    """``(term, estimate)``: ridge logistic regression with unit penalty on the sum of losses, intercept free."""
    t = written(training(df, target, features))
    n, _ = _class_totals(t)
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=max_iter, tol=1e-9, regParam=1.0 / n, elasticNetParam=0.0, standardization=False).fit(t)
    discard(t)
    rows = [("Intercept", float(fit.intercept)), *zip(features, map(float, fit.coefficients), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double")


def forest_fit(
    df: DataFrame,
    target: str,
    features: list[str],
    trees: int = 100,
    depth: int = 15,
    min_leaf: int = 2,
    seed: int = 1
) -> RandomForestClassificationModel:
    t = written(training(df, target, features))
    _class_totals(t)
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed).fit(t)
    discard(t)
    return model


def forest_apply(model: RandomForestClassificationModel, df: DataFrame, features: list[str], keep: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """The ``keep`` columns and ``p``, the chance of the event; rows with NULL in a feature are left out."""
    t = df.select(F.struct(*keep).alias("_keep"), *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=features)
    scored = model.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(t))
    return scored.select("_keep.*", vector_to_array("probability")[1].alias("p"))


def forest_importance(model: RandomForestClassificationModel, df: DataFrame, features: list[str]) -> DataFrame:
    rows = list(zip(features, map(float, model.featureImportances.toArray()), strict=True))
    return df.sparkSession.createDataFrame(rows, "variable string, importance double")


def accuracy_of(scored: DataFrame, y: str, p: str) -> DataFrame:
    """Rows, and the share whose class is the likelier one."""
    return scored.agg(F.count("*").alias("n"), F.avg(((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("double")).alias("accuracy"))


def spatial_fit(
    df: DataFrame, target: str, features: list[str], neighbors: DataFrame, precision: float = 1.0, max_iter: int = 30, tol: float = 1e-3
) -> tuple[dict[str, float], DataFrame]:
    """Coefficients by term, and ``(cell, rho)``: the posterior mode of ``logit p = X beta + rho_cell``.

    ``df`` has a column ``cell``; ``neighbors (cell, neighbor)`` lists both directions of each adjacency and gives rho an
    intrinsic autoregressive prior. Each round solves one weighted least squares step for beta from sums over all rows,
    then moves every rho by a damped Newton step from sums per cell and its neighbours' total; rho is centred at zero.
    Cells without a neighbour have rho 0. It is a point estimate, not draws from a posterior.
    """
    k = len(features) + 1
    base = df.select(
        F.col("cell").cast("long").alias("cell"),
        F.col(target).cast("double").alias("_y"),
        *[F.col(f).cast("double").alias(f"_x{i + 1}") for i, f in enumerate(features)]
    )
    base = written(base.dropna())
    n, events = _class_totals(base)
    links = written(neighbors.select(F.col("cell").cast("long").alias("cell"), F.col("neighbor").cast("long").alias("neighbor")).distinct())
    degree = links.groupBy("cell").agg(F.count("*").alias("degree"))
    rho = written(base.select("cell").union(links.select("cell")).distinct().join(degree, "cell", "left").fillna(0, ["degree"]).withColumn("rho", F.lit(0.0)))
    held = rho
    beta = np.zeros(k)
    beta[0] = np.log(events / (n - events))
    x: list[Column] = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(1, k)]]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def fitted() -> DataFrame:
        p = logistic(sum((x[i] * float(beta[i]) for i in range(1, k)), F.lit(float(beta[0]))) + F.col("rho"))
        return base.join(rho.select("cell", "rho"), "cell").withColumn("_p", p).withColumn("_w", F.col("_p") * (1 - F.col("_p")))

    for _ in range(max_iter):
        # One pass over the rows a round: sums per cell serve both steps, which start from the same fit.
        parts =[
            *[F.sum(F.col("_w") * x[i] * x[j]).alias(f"_c{i}_{j}") for i, j in pairs],
            *[F.sum((F.col("_y") - F.col("_p")) * c).alias(f"_g{i}") for i, c in enumerate(x)]
        ]
        by_cell = written(fitted().groupBy("cell").agg(F.sum(F.col("_y") - F.col("_p")).alias("g"), F.sum("_w").alias("h"), *parts))
        sums = by_cell.agg(*[F.sum(f"_c{i}_{j}") for i, j in pairs], *[F.sum(f"_g{i}") for i in range(k)]).first()
        curve = np.zeros((k, k))
        for (i, j), v in zip(pairs, sums[: len(pairs)], strict=True):
            curve[i, j] = curve[j, i] = v
        step = np.linalg.solve(curve + 1e-9 * np.eye(k), np.array(sums[len(pairs) :], float))
        beta += step
        own = by_cell.select("cell", "g", "h")
        near = links.join(rho.select(F.col("cell").alias("neighbor"), "rho"), "neighbor").groupBy("cell").agg(F.sum("rho").alias("near"))
        t = rho.join(own, "cell", "left").join(near, "cell", "left").fillna(0.0, ["g", "h", "near"])
        slope = F.col("g") - precision * (F.col("degree") * F.col("rho") - F.col("near"))
        moved = F.when(F.col("degree") > 0, F.col("rho") + slope / (F.col("h") + 2 * precision * F.col("degree"))).otherwise(0.0)
        t = with_totals(t.withColumn("to", moved), _m=F.avg(F.when(F.col("degree") > 0, F.col("to"))))
        t = written(t.select("cell", "degree", F.col("rho").alias("was"), F.when(F.col("degree") > 0, F.col("to") - F.col("_m")).otherwise(0.0).alias("rho")))
        change = t.agg(F.max(F.abs(F.col("rho") - F.col("was")))).first()[0]
        discard(by_cell, held)
        held, rho = t, t.select("cell", "degree", "rho")
        if max(change, float(np.abs(step).max())) < tol:
            break
    return dict(zip(["Intercept", *features], beta.tolist(), strict=True)), rho.select("cell", "rho")


def spread_effect(rho: DataFrame, cells_wide: int, csize: int, target: DataFrame) -> DataFrame:
    """``rho (cell, rho)`` between the centres of cells of csize pixels, bilinear at each pixel of ``target (row, col)``."""
    cells = rho.select(F.floor(F.col("cell") / cells_wide).cast("int").alias("row"), (F.col("cell") % cells_wide).cast("int").alias("col"), "rho")
    return regrid(cells, target, "rho", float(csize), True)
