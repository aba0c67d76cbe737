"""Exact positions and quantiles of large groups: rows are dealt out by ranges, so no group has to fit one task.

Each range counts its rows; the running totals over the ranges (a row a range and group) give every range the position it
starts at, and what is left is an order within a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.sources.shared import written


def _ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` written in ranges of ``keys``, with the number of the range in ``_range``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))


def _placed(t: DataFrame, by: Sequence[str], order: str, size: Column) -> DataFrame:
    """``t`` with ``_before``: the sum of ``size`` over the rows of the same ``by`` that come earlier by ``order``."""
    totals = t.groupBy(*by, "_range").agg(F.sum(size).alias("_size"))
    run = Window.partitionBy(*by).orderBy("_range")  # a row a range
    starts = totals.select(  # written, as Spark takes it for as large as the rows until it has a size
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col("_range").alias("_r"),
        (F.sum("_size").over(run) - F.col("_size")).alias("_start")
    )
    starts = written(starts)
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy(*by, "_range").orderBy(order)
    earlier = F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("_in", earlier).join(starts, same).withColumn("_before", (F.col("_start") + F.col("_in")).cast("long")).drop(
        "_in",
        "_start",
        "_r",
        "_range",
        *[f"_by{i}" for i in range(len(by))]
    )


def positions(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """``df`` with ``_at``: the position (from 0) of each row among those of the same ``by``, by ``order``."""
    return _placed(_ranged(df, [*by, order]), by, order, F.lit(1)).withColumnRenamed("_before", "_at")


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Per ``by``: ``_q0, _q1, ...``, the quantiles of the non-NULL values with linear interpolation. Without ``by``, one row.

    Groups without a value are left out, but for the only group of an empty ``by``, whose quantiles are then NULL.
    """
    v = F.col(value).cast("double").alias("_v")
    counts = df.select(*by, v).filter("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_k"))
    t = _placed(_ranged(counts, [*by, "_v"]), by, "_v", F.col("_k"))
    n = t.groupBy(*by).agg(F.sum("_k").alias("_n"))
    t = t.join(n, list(by)) if by else t.crossJoin(F.broadcast(n))  # one row
    out = []
    for i, q in enumerate(probs):
        at = (F.col("_n") - 1) * F.lit(float(q))
        low = F.floor(at)
        holds = lambda place: (F.col("_before") <= place) & (place < F.col("_before") + F.col("_k"))
        a, b = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(F.ceil(at)), F.col("_v")))
        out.append((a + (F.max(at) - F.max(low)) * (b - a)).alias(f"_q{i}"))
    return t.groupBy(*by).agg(*out)
