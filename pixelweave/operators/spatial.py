"""Deviations and intervals of the coefficients of a logistic regression with a spatial effect per cell.

Near its mode the posterior is a normal distribution whose precision is the curvature there:

    [ A   B ]   A = X' W X            of the coefficients
    [ B'  C ]   C = diag(h) + tau * Q  of the effects; h sums W per cell, Q is the Laplacian of the cell graph

The effects sum to zero, which is a constraint on them. The covariance of the coefficients is the inverse of A - B C⁻ B',
with C⁻ the inverse of C under the constraint. C has a row a cell, so it is never formed: C Z = [B', 1] is solved for all
columns at once by conjugate gradients, a join of the cells with their neighbours a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.scalars import logistic
from pixelweave.operators.stats import deviance
from pixelweave.sources.shared import discard, written

NORMAL_975 = 1.959963984540054


def _predictor(features: list[str], beta: dict[str, float]) -> Column:
    return sum((F.col(f).cast("double") * float(beta[f]) for f in features), F.lit(float(beta["Intercept"]))) + F.col("rho")


def covariance(df: DataFrame, target: str, features: list[str], neighbors: DataFrame, beta: dict[str, float], rho: DataFrame, precision: float = 1.0, tol: float = 1e-9, max_iter: int = 500) -> np.ndarray:
    """Covariance of ``Intercept, *features`` at a fit of ``models.spatial_fit`` with the same arguments."""
    k = len(features) + 1
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    rows = df.dropna(subset=[target, *features, "cell"]).join(rho.select("cell", "rho"), "cell")
    p = logistic(_predictor(features, beta))
    w = F.col("_w")
    rows = rows.withColumn("_w", p * (1 - p))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cells = written(rows.groupBy(F.col("cell").cast("long").alias("cell")).agg(*[F.sum(w * x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs]))
    total = cells.agg(*[F.sum(f"a{i}_{j}") for i, j in pairs]).first()
    a = np.zeros((k, k))
    for (i, j), v in zip(pairs, total, strict=True):
        a[i, j] = a[j, i] = v
    links = written(neighbors.select(F.col("cell").cast("long").alias("cell"), F.col("neighbor").cast("long").alias("neighbor")).distinct())
    # Only cells with neighbours have an effect. h and B come from the sums with the intercept.
    degree = links.groupBy("cell").agg(F.count("*").alias("degree"))
    system = degree.join(cells.select("cell", *[F.col(f"a0_{i}").alias(f"b{i}") for i in range(k)]), "cell", "left").fillna(0.0, [f"b{i}" for i in range(k)])
    system = written(system.select("cell", "degree", *[f"b{i}" for i in range(k)], F.lit(1.0).alias(f"b{k}")).withColumn("_d", F.col("b0") + precision * F.col("degree")))
    z = _solved(system, links, [f"b{i}" for i in range(k + 1)], precision, tol, max_iter)
    met = system.join(z, "cell").agg(*[F.sum(F.col(f"b{i}") * F.col(f"z{j}")) for i in range(k + 1) for j in range(k + 1)]).first()
    inner = np.array([v or 0.0 for v in met], float).reshape(k + 1, k + 1)
    inner = (inner + inner.T) / 2
    through = inner[:k, :k] - (np.outer(inner[:k, k], inner[:k, k]) / inner[k, k] if inner[k, k] else 0.0)
    discard(cells, links, system, z)
    return np.linalg.inv(a - through)


def _solved(system: DataFrame, links: DataFrame, right: list[str], precision: float, tol: float, max_iter: int) -> DataFrame:
    """``(cell, z0, z1, ...)`` with ``C z = b`` for each column of ``right``, by conjugate gradients with the diagonal of C as
    preconditioner. Two rows of sums a round come to the driver; vectors stay in tables, and those of the round before go."""
    n = len(right)
    d = F.col("_d")
    names = [f"{v}{i}" for i in range(n) for v in "zrp"]
    start = {"z": lambda i: F.lit(0.0), "r": lambda i: F.col(right[i]), "p": lambda i: F.col(right[i]) / d}
    state = system.select("cell", "degree", "_d", *[start[v](i).alias(f"{v}{i}") for i in range(n) for v in "zrp"])
    size = lambda t: [x or 0.0 for x in t.agg(*[F.sum(F.col(f"r{i}") * F.col(f"r{i}") / d) for i in range(n)]).first()]
    first = now = size(state)
    held: DataFrame | None = None
    for _ in range(max_iter):
        if all(x <= tol * tol * y or y == 0 for x, y in zip(now, first, strict=True)):
            break
        near = links.join(state.select(F.col("cell").alias("neighbor"), *[f"p{i}" for i in range(n)]), "neighbor")
        near = near.groupBy("cell").agg(*[F.sum(f"p{i}").alias(f"n{i}") for i in range(n)])
        q = [(d * F.col(f"p{i}") - precision * F.coalesce(f"n{i}", F.lit(0.0))).alias(f"q{i}") for i in range(n)]
        step = written(state.join(near, "cell", "left").select("cell", "degree", "_d", *names, *q))
        curve = step.agg(*[F.sum(F.col(f"p{i}") * F.col(f"q{i}")) for i in range(n)]).first()
        by = [x / c if c else 0.0 for x, c in zip(now, curve, strict=True)]
        moved = step.select(
            "cell", "degree", "_d",
            *[(F.col(f"z{i}") + by[i] * F.col(f"p{i}")).alias(f"z{i}") for i in range(n)],
            *[(F.col(f"r{i}") - by[i] * F.col(f"q{i}")).alias(f"r{i}") for i in range(n)],
            *[f"p{i}" for i in range(n)],
        )
        before, now = now, size(moved)
        turn = [x / y if y else 0.0 for x, y in zip(now, before, strict=True)]
        state = moved.select("cell", "degree", "_d", *[f"{v}{i}" for v in "zr" for i in range(n)], *[(F.col(f"r{i}") / d + turn[i] * F.col(f"p{i}")).alias(f"p{i}") for i in range(n)])
        if held is not None:
            discard(held)
        held = step
    else:
        raise ValueError(f"no solution within {tol} after {max_iter} rounds")
    out = written(state.select("cell", *[f"z{i}" for i in range(n)]))
    if held is not None:
        discard(held)
    return out


def coefficient_table(spark, beta: dict[str, float], cov: np.ndarray) -> DataFrame:
    """``(term, estimate, std, ci_low, ci_high)``: 95 % intervals of the normal distribution at the mode."""
    std = np.sqrt(np.diag(cov))
    rows = [(n, float(b), float(s), float(b - NORMAL_975 * s), float(b + NORMAL_975 * s)) for (n, b), s in zip(beta.items(), std, strict=True)]
    return spark.createDataFrame(rows, "term string, estimate double, std double, ci_low double, ci_high double")


def spatial_statistics(df: DataFrame, target: str, features: list[str], beta: dict[str, float], rho: DataFrame) -> DataFrame:
    """One row of a fit: rows, events, deviance, deviance of the intercept alone, and range, mean and deviation of the effects."""
    rows = df.dropna(subset=[target, *features, "cell"]).join(rho.select("cell", "rho"), "cell")
    scored = rows.select(F.col(target).cast("double").alias("y"), logistic(_predictor(features, beta)).alias("p"))
    n = scored.agg(F.count("*").alias("n_rows"), F.sum("y").cast("long").alias("n_events"))
    effects = rho.agg(F.min("rho").alias("rho_min"), F.max("rho").alias("rho_max"), F.avg("rho").alias("rho_mean"), F.stddev_samp("rho").alias("rho_std"))
    return n.crossJoin(F.broadcast(deviance(scored, "y", "p"))).crossJoin(F.broadcast(effects))  # one row each
