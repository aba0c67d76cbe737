"""Mixing sources to target weights: balanced sampling by the cube method.

A source's target over its size is a rate; every document of it is taken floor(rate) times, and once more with the rest of
the rate as inclusion probability. These probabilities move through the null space of two constraints, the words and the
documents of the source, until they are 0 or 1:

* Flight. In a block of one source, three undecided documents at a time move along the vector that changes neither sum, one
  way or the other at random with zero mean, until one of them is decided; at most two stay open. Blocks are dealt by a hash
  of the document, so a hot source is many blocks. What stays open in the blocks meets in blocks of the next level.
* Landing. Where one block of a source is left, the flight ends at ``LAND`` open documents; of their 2**LAND outcomes the one
  nearest to the words and documents that they stand for is taken.

Documents that are large for a block of their source fly and land first. What their landing leaves is a shift of the
probabilities of all other documents of the source, whose flight then keeps the sum (words come before documents there).

Defined cases: a null text has size 0; null is a source of its own, the last; a source without words has target 0; null ids
are kept; repeated rows are documents of their own (rows equal in id and text share a block); an empty table gives an empty
result. Blocks and random numbers follow from ids and texts, so reruns agree, whatever the partitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import discard, table, written
from pixelweave.operators.ranks import positions

BLOCK = 2_000
LAND = 10
LARGE = 200  # a document is large if it holds more than 1/LARGE of the mean block of its source
NEAR = 1e-9


def word_count(text: Column) -> Column:
    """Matches of ``[^\\x20\\x09-\\x0D]+``: each word becomes one character, white space goes."""
    marks = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.octet_length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def flight(size: Sequence[float], pi: list[float], draws: Sequence[float], stop: int) -> list[int]:
    """Move ``pi`` in place until at most ``stop`` (two or more) places are open; returns these. Sums of ``pi`` and of
    ``size * pi`` stay."""
    pool: list[int] = []
    for i in range(len(pi)):
        pool.append(i)
        if len(pool) + len(pi) - i - 1 <= stop:
            return pool + list(range(i + 1, len(pi)))
        while len(pool) == 3:
            a, b, c = pool
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            move = [(k, x) for k, x in zip(pool, u, strict=True) if x]
            up = min((1 - pi[k]) / x if x > 0 else pi[k] / -x for k, x in move)
            down = min(pi[k] / x if x > 0 else (1 - pi[k]) / -x for k, x in move)
            step = up if draws[i] * (up + down) < down else -down
            for k, x in move:
                pi[k] += step * x
                if pi[k] < NEAR or pi[k] > 1 - NEAR:
                    pi[k] = float(round(pi[k]))
                    pool.remove(k)
    return pool


def landing(size: np.ndarray, pi: np.ndarray, give: float = 0.0, take: float = 0.0) -> np.ndarray:
    """The outcome (0 or 1 each) nearest to ``pi``: first in words beyond the ``give`` words that others can drop and the
    ``take`` words that they can add, then in words, where a document too many counts as a twentieth of a mean document."""
    every = np.array(list(itertools.product((0.0, 1.0), repeat=len(pi))))
    over, count = (every - pi) @ size, np.abs((every - pi).sum(axis=1))
    beyond = np.maximum(0, np.maximum(over - give, -over - take))
    far = np.abs(over) / max(1.0, size.mean()) + count / 20
    return every[np.lexsort((np.round(far, 9), np.round(beyond, 6)))[0]]


def _fly(level: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        size, own = t.column("_size").to_numpy(), t.column("_key").to_numpy()
        order = np.lexsort((size, own))  # sizes in no order, so that those left open differ and their sums lie close
        t, size = t.take(order), size[order].astype(float)
        pi = t.column("_pi").to_pylist()
        source, block = (x.as_py() for x in key)
        draws = np.random.default_rng(xxhash.xxh64_intdigest(repr((source, block, level)).encode())).random(len(pi)).tolist()
        last = t.column("_blocks")[0].as_py() == 1
        open_ = flight(size.tolist(), pi, draws, LAND if last else 2)
        if last and open_:
            small, rest = t.column("_small")[0].as_py(), t.column("_rest")[0].as_py()
            for k, x in zip(open_, landing(size[open_], np.array([pi[k] for k in open_]), small * rest, small * (1 - rest)), strict=True):
                pi[k] = float(x)
        return t.set_column(t.schema.get_field_index("_pi"), "_pi", pa.array(pi, pa.float64())).drop_columns(["_b", "_blocks"])

    return run


def _decided(rows: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """``rows`` with ``_pi`` 0 or 1, and the tables that they are in."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    out, made = None, []
    for level in itertools.count():
        counts = rows.groupBy("_source").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks")).withColumnRenamed("_source", "_of")
        dealt = rows.join(counts, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
        dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("_key", F.lit(level)), F.col("_blocks")))
        made.append(written(dealt.groupBy("_source", "_b").applyInArrow(_fly(level), kinds)))
        done = made[-1].filter((F.col("_pi") == 0) | (F.col("_pi") == 1))
        out = done if out is None else out.union(done)
        rows = made[-1].filter((F.col("_pi") > 0) & (F.col("_pi") < 1))
        if rows.isEmpty():
            return out, made


def source_targets(rows: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``rows (_source, _size)`` to ``(_of, _n, _total, _target)``, a row a source. All words are shared by ``weights``,
    repeating in the order of the sources by code point; a target above ``cap`` times its source's words stops there and
    what is over goes to the others by weight: the target is min(cap * words, level * weight) for the one level at which all
    targets sum to all words, found by raising it from the sums of capped words and open weights."""
    sums = written(rows.groupBy("_source").agg(F.count("*").alias("_n"), F.sum("_size").alias("_total")))
    placed = positions(sums.withColumn("_order", F.struct(F.col("_source").isNull().alias("_last"), "_source")), [], "_order")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    t = written(placed.select(F.col("_source").alias("_of"), "_n", "_total", weight.alias("_w")))
    most = F.col("_total") * float(cap)
    words, shares = t.agg(F.sum("_total"), F.sum("_w")).first()
    level, before = (words or 0) / (shares or 1), -1.0
    while level > before:
        full = most <= F.lit(level) * F.col("_w")
        held, shares = t.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.sum(F.when(~full, F.col("_w")))).first()
        if not shares:
            break
        before, level = level, (words - held) / shares
    discard(sums)
    return t.select("_of", "_n", "_total", F.least(most, F.lit(float(level)) * F.col("_w")).alias("_target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    cap: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``docs``: the id, the ``keep`` columns, ``_size``, ``_source_size``, ``_target`` (of its source) and
    ``_copies``, how often the mix takes it."""
    names = [f"_c{i}" for i in range(len(keep) + 1)]
    text = F.col(f"`{text_col}`")
    rows = written(
        docs.select(
            *[F.col(f"`{c}`").alias(n) for c, n in zip((id_col, *keep), names, strict=True)],
            word_count(text).alias("_size"),
            F.col(f"`{source_col}`").cast("string").alias("_source"),
            F.xxhash64(F.col(f"`{id_col}`"), text).alias("_key"),
        )
    )
    sources = source_targets(rows, weights, cap)
    rate = F.coalesce(F.try_divide(F.col("_target"), F.col("_total")), F.lit(0.0))
    copies = F.floor(rate + NEAR)
    rest = F.when(rate - copies > NEAR, rate - copies).otherwise(0.0)
    large = F.col("_size") * F.ceil(F.col("_n") / BLOCK) * LARGE > F.col("_total")
    same = F.col("_source").eqNullSafe(F.col("_of"))
    full = rows.join(sources, same).withColumn("_copies", copies.cast("long")).withColumn("_rest", rest).withColumn("_large", large).drop("_of", "_n")
    small = written(full.groupBy("_source").agg(F.sum(F.when(~F.col("_large"), F.col("_size")).otherwise(0)).alias("_small")).withColumnRenamed("_source", "_of"))
    full = full.join(small, same).drop("_of").withColumn("_pi", F.col("_rest"))
    sure, open_ = full.filter("_rest = 0"), full.filter("_rest > 0")
    first, made = _decided(open_.filter("_large"))
    over = first.groupBy("_source").agg(F.sum(F.col("_size") * (F.col("_pi") - F.col("_rest"))).alias("_over"))
    shift = F.coalesce(F.try_divide(F.col("_over"), F.col("_small")), F.lit(0.0))
    others = open_.filter(~F.col("_large")).join(over.withColumnRenamed("_source", "_of"), same, "left").drop("_of")
    moved = F.least(F.greatest(F.col("_rest") - shift, F.lit(0.0)), F.lit(1.0))
    others = written(others.withColumn("_pi", moved).withColumn("_small", F.lit(0).cast("long")).drop("_over"))
    second, more = _decided(others.filter((F.col("_pi") > 0) & (F.col("_pi") < 1)))
    settled = others.filter((F.col("_pi") == 0) | (F.col("_pi") == 1))
    parts = [x.select(full.columns) for x in (sure, first, settled, second)]
    out = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    out = written(out.select(*names, "_size", "_total", "_target", (F.col("_copies") + F.col("_pi").cast("long")).alias("_copies")))
    discard(rows, small, others, *made, *more)
    given = [F.col(n).alias(c) for n, c in zip(names, (id_col, *keep), strict=True)]
    return out.select(*given, "_size", F.col("_total").alias("_source_size"), "_target", "_copies")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix``'s result as often as it is taken."""
    return mixed.filter("_copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))


def balance(mixed: DataFrame, source_col: str) -> DataFrame:
    """Per source of ``mix``'s result (with the source among the kept columns): target and taken words."""
    return mixed.groupBy(source_col).agg(F.max("_target").alias("target"), F.sum(F.col("_size") * F.col("_copies")).alias("taken"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    taken = (F.col("_size") * F.col("_copies")).alias("taken")
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken)
