"""Projections and predicates of pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(value: Column, mask: Column | None = None) -> Column:
    """Not NULL and, with a mask, under a mask that is neither NULL nor zero."""
    out = value.isNotNull()
    return out & F.coalesce(mask != 0, F.lit(False)) if mask is not None else out


def suppressed(mask: Column, values: Sequence[int]) -> Column:
    return mask.isNull() | mask.isin(*values)


def unmasked(value: Column, fill: int = 0) -> Column:
    return F.coalesce(value, F.lit(fill))


def to_binary(value: Column, ones: Sequence[int], zeros: Sequence[int]) -> Column:
    """Ones win where both lists hold a value; other values are NULL."""
    if not ones or not zeros:
        raise ValueError("both lists of values are needed")
    return F.when(value.isin(*ones), 1).when(value.isin(*zeros), 0)


def change(before: Column, after: Column, kind: str, event: int = 1) -> Column:
    """Loss: event where 1 became 0, its opposite where it stayed 1. Gain: event where 0 became 1, else where it stayed 0."""
    start = {"loss": 1, "gain": 0}[kind]
    return F.when((before == start) & (after == 1 - start), event).when((before == start) & (after == start), 1 - event)


def three_dates(a: Column, b: Column, c: Column) -> Column:
    """1 lost between the first two dates, 2 lost between the last two, 3 present at the last, 0 else."""
    a, b, c = (F.coalesce(x, F.lit(0)) for x in (a, b, c))
    return F.when((a == 1) & (b == 0) & (c == 0), 1).when((a == 1) & (b == 1) & (c == 0), 2).when(c == 1, 3).otherwise(0)


def loss_pairs(df: DataFrame, layers: Sequence[tuple[int, str]]) -> DataFrame:
    """Long table (pair, row, col, value) of the three pairings of three dates."""
    if len(layers) != 3 or len({y for y, _ in layers}) != 3:
        raise ValueError("three layers of distinct years are needed")
    pairs = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        (y1, a), (y2, b) = layers[i], layers[j]
        pairs.append(F.struct(F.lit(f"forest_loss_{y1}_{y2}").alias("pair"), change(F.col(a), F.col(b), "loss").alias("value")))
    out = df.select("row", "col", F.explode(F.array(*pairs)).alias("p"))
    return out.select("p.pair", "row", "col", "p.value")


def vulnerability(dist: Column, forest: Column, subj: Column, edges: Sequence[float]) -> Column:
    """class * 1000 + jurisdiction; classes count down with distance (right-closed bins), 1 beyond the last edge."""
    above = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < dist))
    cls = F.when(dist > edges[-1], 1).otherwise(len(edges) - above)
    code = (F.when(forest == 1, cls).otherwise(0) * 1000 + subj).cast("int")
    return F.when(code > 1000, code)


def zero_beyond(cat: Column, dist: Column, threshold: float, zero_cat: int = 1) -> Column:
    return F.when(dist > threshold, zero_cat).otherwise(cat)


def cover_at(cover: Column, loss_year: Column, year: int, threshold: int) -> Column:
    """Cover at or over the threshold and not lost before the year; a NULL loss year was never lost."""
    return F.when(F.coalesce(loss_year < year - 2000, F.lit(False)), 0).otherwise((cover >= threshold).cast("int"))


def population(forest: Column, loss: Column) -> Column:
    return F.coalesce((forest == 1) | (loss == 1), F.lit(False)) | F.coalesce(forest == 1, F.lit(False)) | F.coalesce(loss == 1, F.lit(False))


def event(loss: Column) -> Column:
    return F.coalesce(loss == 1, F.lit(False))
