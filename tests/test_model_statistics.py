import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelweave.operators import bagging as B
from pixelweave.operators import models as M
from pixelweave.operators import neighborhood as N
from pixelweave.operators import spatial as SP


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 2))
    cell = rng.integers(0, 12, 500)
    y = rng.random(500) < 1 / (1 + np.exp(-(-0.5 + 1.5 * x[:, 0] + 0.8 * (cell % 3 - 1))))
    rows = [(i, i % 7, int(v), float(a), float(b), int(c)) for i, (v, (a, b), c) in enumerate(zip(y, x, cell, strict=True))]
    return spark.createDataFrame([*rows, (900, 0, None, 1.0, 1.0, 1), (901, 0, 1, None, 1.0, 1)], "row int, col int, y int, a double, b double, cell long")


def count_in_bag(row, col, tree, seed):
    h = 42
    for v in (row, col, tree, seed):
        h = xxhash.xxh64_intdigest(int(v).to_bytes(4, "little", signed=True), seed=h)
    u = (h % 2**53) / 2**53  # the hash is signed in Spark; 2**53 divides 2**64, so the remainder is the same
    total, k = math.exp(-1), 0
    while u >= total and k < 11:
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return k


def test_bags_are_poisson_counts_of_a_hash(train):
    got = train.select("row", "col", *[B.in_bag(["row", "col"], t, 7).alias(f"w{t}") for t in range(4)]).collect()
    for r in got:
        assert [r[f"w{t}"] for t in range(4)] == [count_in_bag(r.row, r.col, t, 7) for t in range(4)]
    every = np.array([[r[f"w{t}"] for t in range(4)] for r in got])
    assert abs(every.mean() - 1) < 0.08 and abs((every == 0).mean() - math.exp(-1)) < 0.05
    assert abs(np.corrcoef(every[:, 0], every[:, 1])[0, 1]) < 0.15


def test_out_of_bag_score_is_that_of_the_trees_that_did_not_see_the_row(train):
    forest = B.forest_fit(train, "y", ["a", "b"], trees=6, depth=5, seed=3)
    each = {(r._keep.row, r._keep.col): r._p for r in B.tree_scores(forest, train, ("row", "col")).collect()}
    got = B.out_of_bag(forest, train, "y").collect()
    assert len(got) == 500
    right, scored = 0, 0
    for r in got:
        unseen = [t for t in range(6) if count_in_bag(r.row, r.col, t, 3) == 0]
        assert r.n_trees == len(unseen)
        if unseen:
            want = np.mean([each[r.row, r.col][t] for t in unseen])
            assert math.isclose(r.p, want, abs_tol=1e-12)
            scored, right = scored + 1, right + ((want > 0.5) == (r.y == 1))
        else:
            assert r.p is None
    stats = B.forest_statistics(forest, train, "y").first()
    assert (stats.n_rows, stats.n_scored) == (500, scored) and math.isclose(stats.oob_accuracy, right / scored)
    seen = B.forest_apply(forest, train, ("row", "col", "y")).filter("y IS NOT NULL").agg(F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double"))).first()[0]
    assert seen > stats.oob_accuracy > 0.6
    shares = B.importances(forest)
    assert shares["a"] > shares["b"] and math.isclose(sum(shares.values()), 1)
    with pytest.raises(ValueError):
        B.forest_fit(train.filter("y = 1"), "y", ["a"], trees=1)


def test_deviations_equal_dense_algebra(spark, train):
    cells = spark.range(12).select(F.col("id").alias("cell"))
    links = N.cell_neighbors(cells, 4, 3)
    features = ["a", "b"]
    beta, rho = M.spatial_fit(train, "y", features, links, precision=0.7, tol=1e-4)
    cov = SP.covariance(train, "y", features, links, beta, rho, precision=0.7)
    t = train.dropna().toPandas()
    effect = {r.cell: r.rho for r in rho.collect()}
    x = np.c_[np.ones(len(t)), t[features].to_numpy()]
    z = np.eye(12)[t["cell"].to_numpy()]
    p = 1 / (1 + np.exp(-(x @ np.array([beta[n] for n in ("Intercept", *features)]) + t["cell"].map(effect).to_numpy())))
    w = (p * (1 - p))[:, None]
    graph = np.zeros((12, 12))
    for r in links.collect():
        graph[r.cell, r.neighbor] -= 1
        graph[r.cell, r.cell] += 1
    full = np.block([[x.T @ (w * x), x.T @ (w * z)], [z.T @ (w * x), z.T @ (w * z) + 0.7 * graph]])
    line = np.r_[np.zeros(3), np.ones(12)]
    bordered = np.block([[full, line[:, None]], [line[None, :], np.zeros((1, 1))]])  # effects that sum to zero
    want = np.linalg.inv(bordered)[:3, :3]
    assert np.allclose(cov, want, rtol=1e-6)
    table = {r.term: r for r in SP.coefficient_table(spark, beta, cov).collect()}
    assert math.isclose(table["a"].std, math.sqrt(want[1, 1]), rel_tol=1e-6) and math.isclose(table["a"].ci_high - table["a"].estimate, 1.959963984540054 * table["a"].std)
    row = SP.spatial_statistics(train, "y", features, beta, rho).first()
    assert row.n_rows == 500 and row.deviance < row.null_deviance and math.isclose(row.rho_max, max(effect.values()))
    assert math.isclose(row.deviance, -2 * np.sum(np.log(np.where(t["y"] == 1, p, 1 - p))), rel_tol=1e-9)
