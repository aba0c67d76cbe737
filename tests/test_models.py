import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import catalog as C
from pixelweave.operators import geometry as GEO
from pixelweave.operators import models as M
from pixelweave.operators import neighborhood as N
from pixelweave.operators import stats as T
from pixelweave.operators import tiles as TI
from pixelweave.sources import layers as IO


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    cell = rng.integers(0, 9, 600)
    y = rng.random(600) < 1 / (1 + np.exp(-(-0.5 + 1.5 * x[:, 0] + 0.8 * (cell % 3 - 1))))
    rows = [(int(v), float(a), float(b), int(c)) for v, (a, b), c in zip(y, x, cell, strict=True)]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1), (1, None, 1.0, 1)], "y int, a double, b double, cell int")


def test_glm_fit_solves_the_ridge_objective(train):
    est = {r.term: r.estimate for r in M.glm_fit(train, "y", ["a", "b"]).collect()}
    t = train.dropna().toPandas()
    x, beta = t[["a", "b"]].to_numpy(), np.array([est["a"], est["b"]])
    rest = t["y"].to_numpy() - 1 / (1 + np.exp(-(est["Intercept"] + x @ beta)))
    assert abs(rest.sum()) < 1e-2 and np.abs(x.T @ rest - beta).max() < 1e-2
    with pytest.raises(ValueError):
        M.glm_fit(train.filter("y = 1"), "y", ["a"])


def test_spatial_fit_is_a_stationary_point(spark, train):
    cells = spark.range(9).select(F.col("id").alias("cell"))
    links = N.cell_neighbors(cells, 3, 3)
    beta, rho = M.spatial_fit(train, "y", ["a", "b"], links, tol=1e-4, max_iter=25)
    effect = {r.cell: r.rho for r in rho.collect()}
    t = train.dropna().toPandas()
    x = np.c_[np.ones(len(t)), t[["a", "b"]].to_numpy()]
    rest = t["y"].to_numpy() - 1 / (1 + np.exp(-(x @ np.array([beta[k] for k in ("Intercept", "a", "b")]) + t["cell"].map(effect).to_numpy())))
    near = {}
    for r in links.collect():
        near.setdefault(r.cell, []).append(effect[r.neighbor])
    assert np.abs(x.T @ rest).max() < 0.2 and abs(sum(effect.values())) < 1e-6
    for c in range(9):
        assert abs(rest[(t["cell"] == c).to_numpy()].sum() - sum(effect[c] - v for v in near[c])) < 0.2
    assert effect[2] > effect[0]


def test_forest_learns_a_threshold(train):
    px = train.withColumn("y", (F.col("a") > 0).cast("int"))
    model = M.forest_fit(px, "y", ["a", "b"], trees=10, depth=4)
    found = M.accuracy_of(M.forest_apply(model, px, ["a", "b"], ("y",)), "y", "p").first()
    assert found.n == 601 and found.accuracy > 0.97
    assert {r.variable for r in M.forest_importance(model, px, ["a", "b"]).filter("importance > 0.5").collect()} == {"a"}


def test_effective_sample_size(spark):
    rng = np.random.default_rng(2)
    walk = np.zeros(300)
    for i in range(1, 300):
        walk[i] = 0.95 * walk[i - 1] + rng.normal()
    traces = {"walk": walk, "noise": rng.normal(size=300), "flat": np.ones(50), "short": np.arange(3.0)}
    rows = [(i, k, float(v)) for k, t in traces.items() for i, v in enumerate(t)]
    got = {r.param: r.ess for r in T.effective_sample_size(spark.createDataFrame(rows, "iter int, param string, value double"), block=4).collect()}
    assert got["flat"] is None and got["short"] is None
    for k in ("walk", "noise"):
        c = traces[k] - traces[k].mean()
        rho = [(c[: 300 - lag] * c[lag:]).sum() / (c * c).sum() for lag in range(300)]
        tail, lag = 0.0, 1
        while lag + 1 < 300 and rho[lag] + rho[lag + 1] > 0:
            tail, lag = tail + rho[lag] + rho[lag + 1], lag + 2
        assert abs(got[k] - min(max(300 / (1 + 2 * tail), 1), 300)) < 1e-6


def polygon(*points):
    return [[list(map(float, p)) for p in (*points, points[0])]]


def test_touched_pixels(spark):
    shapes = spark.createDataFrame([(1, polygon((0.5, -0.5), (4.5, -0.5), (0.5, -3.5))), (2, polygon((8.2, -6.2), (8.4, -6.2), (8.4, -6.4))), (3, None)], "feature_id long, rings array<array<array<double>>>")
    got = {(r.row, r.col) for r in GEO.touched(shapes, 10, 0.0, 0.0, 1.0, 10).collect()}
    # The slanted edge has x = 4.5 - 4 (d - 0.5) / 3 at depth d: row r is met up to its x at the row's top.
    want = {(r, c) for r in range(4) for c in range(int(4.5 - 4 * (max(r, 0.5) - 0.5) / 3) + 1)} | {(6, 8)}
    assert got == want
    px = spark.createDataFrame([(0, 0, 1), (9, 9, 2), (6, 8, 3)], "row int, col int, v int")
    assert sorted(r.v for r in GEO.crop(px, shapes, 10, 0.0, 0.0, 1.0, 10).collect()) == [1, 3]


def test_features_meeting_areas(spark):
    kind = "feature_id long, rings array<array<array<double>>>"
    areas = spark.createDataFrame([(1, polygon((0, 0), (10, 0), (10, 10), (0, 10)))], kind)
    features = [(1, polygon((2, 2), (3, 2), (3, 3))), (2, polygon((20, 20), (21, 20), (21, 21))), (3, polygon((9, 9), (12, 9), (12, 12))), (4, polygon((-5, -5), (50, -5), (50, 50), (-5, 50))), (5, polygon((11, -1), (13, 11), (13, -1))), (6, None)]
    got = GEO.meeting(spark.createDataFrame(features, kind), areas, 4.0)
    assert sorted(r.feature_id for r in got.collect()) == [1, 3, 4]


def test_tiles_and_predictions(spark):
    px = spark.range(100).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").alias("v"))
    sums = TI.map_tiles(px, lambda t: t.assign(r=t["row"] // 5, c=t["col"] // 5).groupby(["r", "c"], as_index=False)["v"].sum(), "r int, c int, v long", 5)
    assert sums.count() == 4 and sums.agg(F.sum("v")).first()[0] == 4950
    assert TI.predict_with(px, lambda t: t["v"] / 2).agg(F.sum("p")).first()[0] == 2475.0


def test_exported_layers(spark, tmp_path):
    px = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, None, 3.0)], "row int, col int, a double, b double")
    paths = IO.export_layers(px, ["a", "b"], str(tmp_path), "x_", "_30m")
    assert [sorted(r.value or 0 for r in IO.read_layer(spark, p).collect()) for p in paths] == [[0, 1.0], [2.0, 3.0]]


def test_periods_and_rate_tables(spark):
    got = {r.period: (r.initial_year, r.final_year, r.defor_values, r.layer_year) for r in C.periods(spark.createDataFrame([("f", 2015, 2020, 2024)], "name string, y1 int, y2 int, y3 int")).collect()}
    assert got == {"calibration": (2015, 2020, [1], 2015), "validation": (2020, 2024, [1], 2020), "historical": (2015, 2024, [1, 2], 2015), "forecast": (2015, 2024, [1, 2], 2024)}
    rows = [("p", "import", "evaluation", "old", 1), ("p", "import", "evaluation", "new", 2), ("p", "import", "persisted", "x", 3), ("q", "mw", "sibling", "s", 1), ("q", "mw", "user", "u", 1), ("r", "jnr", "computed", "c", 1), ("s", "other", "persisted", None, 1)]
    t = spark.createDataFrame(rows, "prediction string, kind string, source string, path string, at long").withColumn("made_at", F.timestamp_seconds("at"))
    assert {(r.prediction, r.path) for r in C.rate_table_source(t).collect()} == {("p", "new"), ("q", "u")}


def test_lagged_sums_over_stretches_do_not_join(spark, monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 1)
    rng = np.random.default_rng(7)
    traces = {"long": rng.normal(size=500), "edge": rng.normal(size=128), "next": rng.normal(size=129), "few": rng.normal(size=5)}
    rows = [(k, i, float(v)) for k, c in traces.items() for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "param string, i long, c double").repartition(3)
    for lags in (range(1, 9), range(9, 17)):
        out = T._lagged_sums(df, lags)
        got = {(r.param, r.lag): r.s for r in out.collect()}
        want = {(k, lag): (c[:-lag] * c[lag:]).sum() for k, c in traces.items() for lag in lags if lag < len(c)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert "Join" not in out._jdf.queryExecution().toString()  # a row a lag, joined, was 32 times the trace


def test_split_rhat_does_not_deal_the_trace_out_by_parameter(spark):
    """Few parameters would be few tasks: their counts come by broadcast once their size is known."""
    trace = spark.range(20_000).select(F.col("id").alias("iter"), F.concat(F.lit("p"), F.col("id") % 3).alias("param"), F.rand(1).alias("value"))
    trace.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/rhat-trace")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        out = T.split_rhat(spark.read.parquet(path))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert all(abs(r.rhat - 1) < 0.01 for r in out.collect()) and out.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
