"""Model statistics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.operators.ranks import positions, quantiles
from pixelweave.sources.shared import discard, written


def layer_summary(px: DataFrame, names: list[str]) -> DataFrame:
    """min, max, mean, population sd and count of each layer, in one pass."""
    aggs = []
    for c in names:
        v = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("layer"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.avg(v).alias("mean"),
                F.stddev_pop(v).alias("std"),
                F.count(v).alias("count")
            )
        )
    return px.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def deviance(df: DataFrame, y: str, p: str) -> DataFrame:
    eps = 2.220446049250313e-16
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    yy = F.col(y)
    mean = F.avg(yy)
    return df.agg(
        (-2 * F.sum(yy * F.ln(q) + (1 - yy) * F.ln(1 - q))).alias("deviance"),
        (-2 * F.count(yy) * (mean * F.ln(mean) + (1 - mean) * F.ln(1 - mean))).alias("null_deviance"),
    )


def trace_summary(trace: DataFrame) -> DataFrame:
    """Mean, deviation and 95 % interval of each parameter of ``trace (iter, param, value)``."""
    ends = quantiles(trace, "value", [0.025, 0.975], ["param"]).toDF("param", "ci_low", "ci_high")
    return trace.groupBy("param").agg(F.avg("value").alias("estimate"), F.stddev_samp("value").alias("std")).join(ends, "param", "left")


def split_rhat(trace: DataFrame) -> DataFrame:
    """Split R-hat of ``trace (iter, param, value)``; NULL for constant or short traces."""
    n = written(trace.groupBy("param").agg(F.floor(F.count("*") / 2).alias("h")))
    t = positions(trace.select("iter", "param", "value"), ["param"], "iter").join(n, "param")
    t = t.filter(F.col("_at") < 2 * F.col("h")).withColumn("half", (F.col("_at") >= F.col("h")).cast("int"))
    halves = t.groupBy("param", "half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    out = halves.groupBy("param").agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.min("n").alias("n"))
    r = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w"))
    return out.select("param", F.when((F.col("w") > 0) & (F.col("n") > 1), r).alias("rhat"))


STRETCH = 4096  # positions of a trace whose lagged products one window takes, at least


def _lagged_sums(t: DataFrame, lags: range) -> DataFrame:
    """``(param, lag, s)`` of ``t (param, i, c)`` with gapless ``i``: the sums of c[i] * c[i + lag], for lags that the trace has.

    Stretches of positions are windows; the first rows of one are also the end of the one before it, for the lags that reach
    over. A row is shuffled once or twice, however many lags there are.
    """
    far = lags[-1]
    size = max(STRETCH, 8 * far)
    home = F.floor(F.col("i") / size)
    parts = F.when((F.col("i") % size < far) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    run = Window.partitionBy("param", "part").orderBy("i")
    own = F.when(home == F.col("part"), F.col("c"))
    products = t.select("param", "i", "c", F.explode(parts).alias("part")).select("param", *[(own * F.lead("c", lag).over(run)).alias(f"l{lag}") for lag in lags])
    sums = products.groupBy("param").agg(F.array(*[F.sum(f"l{lag}") for lag in lags]).alias("sums"))
    return sums.select("param", F.posexplode("sums").alias("at", "s")).filter("s IS NOT NULL").select("param", (F.col("at") + lags[0]).alias("lag"), "s")


def effective_sample_size(trace: DataFrame, block: int = 16) -> DataFrame:
    """``(param, ess)`` of ``trace (iter, param, value)``: Geyer's rule, pairs of autocorrelations up to the first that is
    not positive. Lags are tried ``block`` pairs at a time, and only for parameters whose pairs were all positive so far.
    NULL for constant traces and those of fewer than four values; NULL values take no part.
    """
    known = trace.select("iter", "param", "value").dropna(subset=["value"])
    about = written(
        known.groupBy("param").agg(
            F.avg("value").alias("_m"),
            F.count("*").alias("n"),
            ((F.count("*") >= 4) & (F.min("value") < F.max("value"))).alias("usable")
        )
    )
    t = written(
        positions(known, ["param"], "iter").join(about, "param").select("param", F.col("_at").alias("i"), (F.col("value") - F.col("_m")).alias("c"))
    )
    total = written(t.groupBy("param").agg(F.sum(F.col("c") * F.col("c")).alias("v")).join(about.drop("_m"), "param"))
    live, pairs, first = t.join(total.filter("usable").select("param"), "param", "left_semi"), None, 0
    while True:
        k = F.floor((F.col("lag") + 1) / 2).alias("k")
        s = _lagged_sums(live, range(2 * first + 1, 2 * (first + block) + 1)).groupBy("param", k).agg(F.sum("s").alias("s"), F.max("lag").alias("last"))
        s = written(
            s.join(total, "param").select(
                "param",
                "k",
                (F.col("s") / F.col("v")).alias("pair"),
                ((F.col("s") > 0) & (F.col("last") == 2 * F.col("k"))).alias("good")
            )
        )
        pairs = s if pairs is None else pairs.union(s)
        still = s.groupBy("param").agg(F.count_if("good").alias("g")).filter(F.col("g") == block)
        if still.isEmpty():
            break
        live, first = t.join(still, "param", "left_semi"), first + block
    discard(t)
    stop = pairs.groupBy("param").agg(F.min(F.when(~F.col("good"), F.col("k"))).alias("stop"))
    tail = pairs.join(stop, "param").filter(F.col("stop").isNull() | (F.col("k") < F.col("stop"))).groupBy("param").agg(F.sum("pair").alias("tail"))
    ess = F.greatest(F.least(F.col("n") / (1 + 2 * F.coalesce("tail", F.lit(0.0))), F.col("n").cast("double")), F.lit(1.0))
    return total.join(tail, "param", "left").select("param", F.when(F.col("usable"), ess).alias("ess"))


def strongest_contrast(coefs: DataFrame) -> DataFrame:
    """Per variable the largest contrast, those whose interval excludes zero first."""
    resolved = ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).cast("int")
    w = Window.partitionBy("variable").orderBy(resolved.desc(), F.abs("estimate").desc(), "level")
    return coefs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def importance_top(parts: DataFrame, n: int = 15) -> DataFrame:
    return parts.groupBy("variable").agg(F.sum("value").alias("importance")).orderBy(F.desc("importance"), "variable").limit(n)


def thin_scatter(points: DataFrame, x: str, y: str, order: str, bins: int = 200, most: int = 10_000) -> DataFrame:
    """All points if there are no more than ``most``; else the first point of each of bins x bins squares."""
    b = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), (F.count("*") > most).alias("many"))
    at = lambda v, lo, hi: F.least(F.floor(F.coalesce(F.try_divide((F.col(v) - F.col(lo)) * bins, F.col(hi) - F.col(lo)), F.lit(0.0))), F.lit(bins - 1))
    t = points.join(F.broadcast(b)).withColumn("bx", at(x, "x0", "x1")).withColumn("by", at(y, "y0", "y1"))  # one row
    alone = F.when(F.col("many"), F.lit(None)).otherwise(F.col(order))
    return t.groupBy("bx", "by", alone.alias("alone")).agg(F.min_by(F.struct(order, x, y), order).alias("p")).select("p.*")


def pivot_metric(t: DataFrame, row: str, col: str, metric: str, values: list[int]) -> DataFrame:
    return t.groupBy(row).pivot(col, values).agg(F.first(metric))


def glm_probability(terms: dict[str, tuple[Column, float]], intercept: float) -> Column:
    eta = F.lit(intercept)
    for column, beta in terms.values():
        eta = eta + column * beta
    return 1 / (1 + F.exp(-eta))
