"""A forest whose trees and bags are kept apart, so that every row can be scored by the trees that did not see it.

A row's place in a tree's bag is a count drawn from its key and the tree's number by a hash: a Poisson variable of mean one,
which is what drawing with replacement gives a row of a large table. The same key has the same bags in every run and on every
cluster, and no bag is stored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.sources.shared import discard, written

# Chances of a count of at most 0, 1, 2, ... of a Poisson variable of mean one; the last is one but for 1e-9.
AT_MOST = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(11)]


@dataclass(frozen=True)
class Forest:
    trees: tuple[RandomForestClassificationModel, ...]
    features: tuple[str, ...]
    keys: tuple[str, ...]
    seed: int


def in_bag(keys: Sequence[str], tree: int, seed: int) -> Column:
    """How often the row of a key is in the bag of a tree."""
    u = F.pmod(F.xxhash64(*keys, F.lit(tree), F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))
    return reduce(lambda out, k: F.when(u < AT_MOST[k], k).otherwise(out), range(len(AT_MOST) - 1, -1, -1), F.lit(len(AT_MOST))).cast("double")


def _rows(df: DataFrame, features: Sequence[str], *more: Column) -> DataFrame:
    t = df.select(*more, *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=[*features])
    return VectorAssembler(inputCols=[*features], outputCol="_x").transform(t).drop(*features)


def forest_fit(
    df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = ("row", "col"), trees: int = 100, depth: int = 15, min_leaf: int = 2, seed: int = 1, parallel: int = 4
) -> Forest:
    """``keys`` tell the rows of ``df`` apart; rows with NULL in the target or a feature take no part. ``parallel`` trees grow
    at a time. A target of one class raises ValueError."""
    names = [f"_k{i}" for i in range(len(keys))]
    t = written(_rows(df, features, *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(target).cast("double").alias("_y")).filter("_y IS NOT NULL"))
    n, events = t.agg(F.count("*"), F.sum("_y")).first()
    if not n or events in (0, n):
        raise ValueError("the target needs rows of both classes")

    def grow(tree: int) -> RandomForestClassificationModel:
        bag = t.withColumn("_w", in_bag(names, tree, seed)).filter("_w > 0")
        one = RandomForestClassifier(
            featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed * 100_003 + tree
        )
        return one.fit(bag)

    with ThreadPool(parallel) as pool:
        grown = pool.map(inheritable_thread_target(df.sparkSession)(grow), range(trees))
    discard(t)
    return Forest(tuple(grown), tuple(features), tuple(keys), seed)


def tree_scores(forest: Forest, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns as ``_keep`` and ``_p``, an array of the trees' chances; rows with NULL in a feature are left out."""
    t = _rows(df, forest.features, F.struct(*keep).alias("_keep"))
    for i, tree in enumerate(forest.trees):
        t = tree.copy().setRawPredictionCol("").setPredictionCol("").setProbabilityCol(f"_t{i}").transform(t)
    return t.select("_keep", F.array(*[vector_to_array(f"_t{i}")[1] for i in range(len(forest.trees))]).alias("_p"))


def _mean(values: Column, weights: Column | None = None) -> Column:
    """Mean of an array, or of its places with weight one; NULL without any."""
    if weights is None:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    total = F.aggregate(F.zip_with(values, weights, lambda p, w: p * w), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def forest_apply(forest: Forest, df: DataFrame, keep: Sequence[str] = ("row", "col")) -> DataFrame:
    """The ``keep`` columns and ``p``, the mean chance over the trees."""
    return tree_scores(forest, df, keep).select("_keep.*", _mean(F.col("_p")).alias("p"))


def out_of_bag(forest: Forest, df: DataFrame, target: str) -> DataFrame:
    """The keys, ``y``, ``n_trees`` and ``p`` of the fitting rows: the trees that did not see the row, and their mean chance
    (NULL where every tree saw it)."""
    t = tree_scores(forest, df.filter(F.col(target).isNotNull()), (*forest.keys, target))
    unseen = F.array(*[(in_bag([f"_keep.{k}" for k in forest.keys], i, forest.seed) == 0).cast("double") for i in range(len(forest.trees))])
    t = t.select("_keep.*", "_p", unseen.alias("_u"))
    count = F.aggregate("_u", F.lit(0.0), lambda a, x: a + x).cast("int")
    return t.select(*forest.keys, F.col(target).cast("double").alias("y"), count.alias("n_trees"), _mean(F.col("_p"), F.col("_u")).alias("p"))


def importances(forest: Forest) -> dict[str, float]:
    """Mean over the trees, adding up to one."""
    each = [tree.featureImportances.toArray() for tree in forest.trees]
    mean = sum(each) / len(each)
    return dict(zip(forest.features, (mean / (mean.sum() or 1.0)).tolist(), strict=True))


def forest_statistics(forest: Forest, df: DataFrame, target: str) -> DataFrame:
    """One row of a fit: rows, events, and the share of rows whose class the trees that did not see them get right, of the
    rows that have such trees."""
    scored = out_of_bag(forest, df, target)
    right = ((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")
    return scored.agg(F.count("*").alias("n_rows"), F.sum("y").cast("long").alias("n_events"), F.count("p").alias("n_scored"), F.avg(right).alias("oob_accuracy"))
