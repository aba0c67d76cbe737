"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A vector is padded to a power of two, multiplied by random signs and a fast Hadamard transform three times over, and
hashed to its largest coordinate and that coordinate's sign. ``k`` such hashes make a bucket key and ``tables`` keys are
made per vector. A vector is stored under its own key in each table and asks under the ``probes`` best keys, those that
take runner-up coordinates where they are nearly as large. Vectors that meet are compared in double precision.

``k`` follows the number of vectors, so buckets of unrelated vectors keep about the same size at every scale, and the
number of tables follows ``k``: as many as it takes to find ``recall`` of the pairs that lie exactly at the threshold, by the
share that one table finds of simulated pairs (``tables_for``). Closer pairs are found more surely. Equal vectors are one class.

Near copies are condensed before pairs are made. In each bucket a vector looks at the bucket's first vector only; those
within just under half of the threshold's angle of a leader make up its ball (one of its own for every other vector). Any
two in a ball are links, so they are counted and not compared. Balls that meet in a bucket are compared by their leaders:
by the triangle inequality all pairs of them are links, or none is, or members are compared. The bucket join is an
equi-join of balls that carries 128 sign bits of the leaders and passes on only pairs that these leave possible (six
standard deviations of the bit count), so vectors are fetched for few pairs that are not links.

Defined cases: null, zero-length, all-zero vectors and vectors with a null or non-finite component link with nothing
(n_links 0, own component). Vectors of different lengths never link. Repeated vec_id rows are separate rows of one class.
A null vec_id keeps a null component unless its class holds an id. ``kept`` is vec_id = component_id, false for null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import components, table, written

SKETCH_BITS = 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def padded_length(d: int) -> int:
    """The next power of two, 4 at least: a hash has a best, a second and a third coordinate."""
    return 1 << max(2, (d - 1).bit_length())


def bucket_keys(x: np.ndarray, tables: int, k: int, probes: int, seed: int = 7) -> np.ndarray:
    """(n, tables, at most probes) keys; the first of each table is the vector's own."""
    n, d = x.shape
    wide = padded_length(d)
    probes = min(probes, 2 * k + 1)
    padded = np.zeros((n, wide))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, wide])
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        best, code = [], []
        for _ in range(k):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], wide))
            order = np.argsort(-np.abs(y), axis=1)[:, :3]
            top = np.take_along_axis(y, order, axis=1)
            best.append(np.abs(top))
            code.append(2 * order + (top < 0))
        # Alternatives change one hash to its runner-up or third choice; the cheapest drops in size come first.
        drops = np.concatenate([np.stack([b[:, 0] - b[:, 1], b[:, 0] - b[:, 2]], axis=1) for b in best], axis=1)
        ranked = np.argsort(drops, axis=1)[:, : probes - 1]
        for p in range(probes):
            key = np.full(n, t, np.int64)
            for i in range(k):
                if p == 0:
                    own = code[i][:, 0]
                else:
                    pick = ranked[:, p - 1]
                    own = np.where(pick // 2 == i, code[i][np.arange(n), pick % 2 + 1], code[i][:, 0])
                key = key * np.int64(2 * wide) + own
            out[:, t, p] = key
    return out


def tables_for(d: int, k: int, probes: int, threshold: float, recall: float, pairs: int = 4000) -> int:
    """Tables that find ``recall`` of pairs at the threshold, from the share a table finds of ``pairs`` simulated ones."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, pairs, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    length = np.linalg.norm(y, axis=1)[:, None]
    other = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * np.divide(y, length, out=np.zeros_like(y), where=length > 0)
    a, b = bucket_keys(x, 2, k, probes), bucket_keys(other, 2, k, probes)
    met = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
    missed = 1 - min(max(float(met.mean()), 1e-4), 0.9999)
    return max(2, math.ceil(math.log(1 - recall) / math.log(missed)))


def sign_sketch(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """(n, 2) words of 64 signs of rotated coordinates: vectors at angle t differ in about t / pi of the bits."""
    n, d = x.shape
    wide = padded_length(d)
    padded = np.zeros((n, wide))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, wide])
    signs: list[np.ndarray] = []
    while sum(s.shape[1] for s in signs) < SKETCH_BITS:
        y = padded
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], wide))
        signs.append(y > 0)
    bits = np.concatenate(signs, axis=1)[:, :SKETCH_BITS]
    return np.packbits(bits, axis=1).view(np.int64)


def _keys(tables: int, k: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo in range(0, len(ids), 2000):
                part = ids[lo : lo + 2000]
                vectors = batch.column(1).slice(lo, 2000).to_pylist()
                by_length: dict[int, list[int]] = {}
                for i, v in enumerate(vectors):
                    by_length.setdefault(len(v), []).append(i)
                for length, rows in by_length.items():
                    x = np.array([vectors[i] for i in rows])
                    keys, sketch = bucket_keys(x, tables, k, probes), sign_sketch(x)
                    own = np.zeros(keys.shape, bool)
                    own[:, :, 0] = True
                    spread = lambda y, shape=keys.shape: pa.array(np.broadcast_to(y[:, None, None], shape).ravel())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys.ravel()),
                            pa.array(np.full(keys.size, length, np.int32)),
                            spread(part[rows]),
                            spread(sketch[:, 0]),
                            spread(sketch[:, 1]),
                            pa.array(own.ravel()),
                        ],
                        ["_key", "_len", "_rep", "_s1", "_s2", "_own"],
                    )

    return run


def _to_length_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = np.array(v.as_py())
            x /= np.abs(x).max()  # so that squares of huge or tiny components stay in range
            out.append(x / math.sqrt(float(x @ x)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["_rep", "_v"])


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}._s1").bitwiseXOR(F.col(f"{b}._s1"))) + F.bit_count(F.col(f"{a}._s2").bitwiseXOR(F.col(f"{b}._s2")))


def _with_cosine(pairs: DataFrame, unit: DataFrame) -> DataFrame:
    """``pairs (_a, _b, ...)`` of vectors with their cosine."""
    both = pairs.join(unit.select(F.col("_rep").alias("_a"), F.col("_v").alias("_va")), "_a").join(unit.select(F.col("_rep").alias("_b"), F.col("_v").alias("_vb")), "_b")
    cosine = F.aggregate(F.zip_with("_va", "_vb", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return both.withColumn("_cos", cosine).drop("_va", "_vb")


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def balls(own: DataFrame, unit: DataFrame, radius: float) -> DataFrame:
    """``own (_key, _len, _rep, _s1, _s2)``: ``(_rep, _ball, _off)``, each vector's ball (its leader) and angle to it."""
    first = own.groupBy("_key", "_len").agg(F.min(F.struct("_rep", "_s1", "_s2")).alias("_l")).select("_key", "_len", F.col("_l._rep").alias("_lead"), F.col("_l._s1").alias("_s1"), F.col("_l._s2").alias("_s2"))
    share = radius / math.pi
    limit = round(SKETCH_BITS * share + math.sqrt(SKETCH_BITS * share * (1 - share)))
    met = own.alias("a").join(first.alias("b"), (F.col("a._key") == F.col("b._key")) & (F.col("a._len") == F.col("b._len")) & (F.col("a._rep") > F.col("b._lead")) & (_differ("a", "b") <= limit))
    met = written(met.select("a._rep", "b._lead").distinct())
    # A leader follows no other: leaders that do are no leaders, and whoever has no leader left stands alone.
    led = met.join(met.select(F.col("_rep").alias("_lead")).distinct(), "_lead", "left_anti").groupBy("_rep").agg(F.min("_lead").alias("_lead"))
    near = _with_cosine(led.select(F.col("_rep").alias("_a"), F.col("_lead").alias("_b")), unit).select(F.col("_a").alias("_rep"), F.col("_b").alias("_ball"), _angle(F.col("_cos")).alias("_off"))
    near = near.filter(F.col("_off") <= radius)
    every = unit.select("_rep").join(near, "_rep", "left")
    return every.select("_rep", F.coalesce("_ball", "_rep").alias("_ball"), F.coalesce("_off", F.lit(0.0)).alias("_off"))


def near_links(classes: DataFrame, unit: DataFrame, threshold: float, recall: float = 0.999, probes: int = 5, per_bucket: int = 16) -> tuple[DataFrame, DataFrame]:
    """``classes (_rep, _size)``, ``unit (_rep, _v array<double> of length 1)``, distinct: ``(_rep, _far)``, the vectors that a
    class links with outside itself, and edges ``(_a, _b)`` that connect what links connect."""
    n, d = unit.agg(F.count("*"), F.max(F.size("_v"))).first()
    k = max(1, math.ceil(math.log(max(2, n / per_bucket)) / math.log(2 * padded_length(d or 1))))
    tables = tables_for(d or 1, k, probes, threshold, recall)
    keys = written(unit.select("_rep", "_v").mapInArrow(_keys(tables, k, probes), "_key long, _len int, _rep long, _s1 long, _s2 long, _own boolean"))
    reach, slack = math.acos(max(-1.0, min(1.0, threshold))), 1e-6
    member = written(balls(keys.filter("_own"), unit, max(0.0, reach / 2 - 10 * slack)).join(classes.select("_rep", "_size"), "_rep"))
    ball = member.groupBy("_ball").agg(F.max("_off").alias("_radius"), F.sum("_size").alias("_weight"), (F.count("*") == 1).alias("_single"))
    lead = keys.filter("_own").select(F.col("_rep").alias("_ball"), "_s1", "_s2").dropDuplicates(["_ball"])
    ball = written(ball.join(lead, "_ball"))
    held = keys.select("_key", "_len", "_rep", "_own").join(member.select("_rep", "_ball"), "_rep").groupBy("_key", "_len", "_ball").agg(F.max("_own").alias("_own"))
    held = written(held.join(ball, "_ball"))
    share = F.least((F.lit(reach) + F.col("a._radius") + F.col("b._radius")) / math.pi, F.lit(1.0))
    limit = F.ceil(SKETCH_BITS * share + 6 * F.sqrt(SKETCH_BITS * share * (1 - share)))
    a, b = held.filter("_own").alias("a"), held.alias("b")
    met = a.join(b, (F.col("a._key") == F.col("b._key")) & (F.col("a._len") == F.col("b._len")) & (F.col("a._ball") != F.col("b._ball")) & (_differ("a", "b") <= limit))
    pairs = met.select(F.least("a._ball", "b._ball").alias("_a"), F.greatest("a._ball", "b._ball").alias("_b")).distinct()
    side = lambda x: ball.select(F.col("_ball").alias(f"_{x}"), F.col("_radius").alias(f"_r{x}"), F.col("_weight").alias(f"_w{x}"), F.col("_single").alias(f"_o{x}"))
    pairs = _with_cosine(pairs, unit).join(side("a"), "_a").join(side("b"), "_b")
    wide, angle = F.col("_ra") + F.col("_rb"), _angle(F.col("_cos"))
    verdict = F.when(F.col("_oa") & F.col("_ob"), F.when(F.col("_cos") >= threshold, "all").otherwise("none"))
    verdict = verdict.when(angle + wide <= reach - slack, "all").when(angle - wide > reach + slack, "none").otherwise("some")
    pairs = written(pairs.withColumn("_verdict", verdict).filter("_verdict <> 'none'").select("_a", "_b", "_wa", "_wb", "_oa", "_ra", "_rb", "_verdict"))
    # Members of one ball against the other's leader; those that this leaves open against its members.
    some = pairs.filter("_verdict = 'some'")
    one = some.select(F.when(F.col("_oa"), F.col("_b")).otherwise(F.col("_a")).alias("_ball"), F.when(F.col("_oa"), F.col("_a")).otherwise(F.col("_b")).alias("_other"), F.when(F.col("_oa"), F.col("_wa")).otherwise(F.col("_wb")).alias("_w"), F.when(F.col("_oa"), F.col("_ra")).otherwise(F.col("_rb")).alias("_r"))
    each = one.join(member.select("_ball", "_rep", "_size"), "_ball").select(F.col("_rep").alias("_a"), F.col("_other").alias("_b"), "_size", "_w", "_r")
    each = _with_cosine(each, unit)
    part = F.when(F.col("_r") == 0, F.when(F.col("_cos") >= threshold, "all").otherwise("none"))
    part = part.when(_angle(F.col("_cos")) + F.col("_r") <= reach - slack, "all").when(_angle(F.col("_cos")) - F.col("_r") > reach + slack, "none").otherwise("some")
    each = written(each.withColumn("_verdict", part).filter("_verdict <> 'none'").drop("_cos"))
    last = each.filter("_verdict = 'some'").select("_a", F.col("_b").alias("_ball"), F.col("_size").alias("_sa")).join(member.select("_ball", F.col("_rep").alias("_b"), F.col("_size").alias("_sb")), "_ball")
    last = written(_with_cosine(last.select("_a", "_b", "_sa", "_sb"), unit).filter(F.col("_cos") >= threshold).select("_a", "_b", "_sa", "_sb"))
    whole, sure = pairs.filter("_verdict = 'all'"), each.filter("_verdict = 'all'")
    # What all members of a ball link with, and what single members do.
    shared = whole.select(F.col("_a").alias("_ball"), F.col("_wb").alias("_n")).union(whole.select("_b", "_wa")).union(sure.select("_b", "_size")).groupBy("_ball").agg(F.sum("_n").alias("_shared"))
    alone = sure.select(F.col("_a").alias("_rep"), F.col("_w").alias("_n")).union(last.select("_a", "_sb")).union(last.select("_b", "_sa")).groupBy("_rep").agg(F.sum("_n").alias("_alone"))
    t = member.join(ball.select("_ball", "_weight"), "_ball").join(shared, "_ball", "left").join(alone, "_rep", "left")
    far = t.select("_rep", (F.col("_weight") - F.col("_size") + F.coalesce("_shared", F.lit(0)) + F.coalesce("_alone", F.lit(0))).alias("_far"))
    edges = whole.select("_a", "_b").union(sure.select("_a", "_b")).union(last.select("_a", "_b")).union(member.filter("_rep <> _ball").select("_rep", "_ball"))
    return far, edges


def embedding_components(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, recall: float = 0.999) -> DataFrame:
    """Per row of ``rows``: the id, ``_n_links`` and ``_component``."""
    v = F.col(vec_col).cast("array<double>")
    valid = F.coalesce(
        (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    base = rows.select(F.col(id_col).cast("long").alias("_id"), F.when(valid, v).alias("_v"), F.xxhash64(v).alias("_hash"))
    # One class per distinct vector, numbered as the table of classes is written.
    classes = base.filter("_v IS NOT NULL").groupBy("_hash", "_v").agg(F.count("*").alias("_size"), F.min("_id").alias("_first"))
    classes = written(classes.withColumn("_rep", F.monotonically_increasing_id()))
    unit = written(classes.select("_rep", "_v").mapInArrow(_to_length_one, "_rep long, _v array<double>"))
    far, edges = near_links(classes, unit, threshold, recall)
    comp = components(edges).withColumnRenamed("_node", "_rep")
    named = classes.select("_rep", "_size", "_first").join(comp, "_rep", "left").join(far, "_rep", "left")
    named = written(named.select("_rep", "_first", (F.col("_size") - 1 + F.coalesce("_far", F.lit(0))).alias("_n_links"), F.coalesce("_comp", "_rep").alias("_comp")))
    smallest = named.groupBy("_comp").agg(F.min("_first").alias("_component"))
    named = named.join(smallest, "_comp").select("_rep", "_n_links", "_component")
    ids = base.filter("_v IS NOT NULL").join(classes.select("_hash", "_v", "_rep"), ["_hash", "_v"]).select("_id", "_rep")
    joined = ids.join(named, "_rep").select("_id", "_n_links", "_component")
    alone = base.filter("_v IS NULL").select("_id", F.lit(0).cast("long").alias("_n_links"), F.col("_id").alias("_component"))
    return joined.unionByName(alone).withColumnRenamed("_id", id_col)


def op9_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_components(table(spark, sf_dir, "embeddings"))
    return out.select(
        "vec_id",
        F.col("_n_links").alias("n_links"),
        F.col("_component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("_component"), F.lit(False)).alias("kept"),
    )


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
