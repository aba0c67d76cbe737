import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.grid import GridSpec
from pixelweave.operators import design as DE
from pixelweave.operators import derived as D
from pixelweave.operators import neighborhood as N
from pixelweave.operators import ranks as K
from pixelweave.operators import sampling as P
from pixelweave.operators import workflows as WF
from pixelweave.sources import layers as IO


@pytest.fixture(scope="module")
def px(spark):
    rng = np.random.default_rng(1)
    rows = [(r, c, *map(int, rng.integers(0, 2, 2)), float(rng.integers(0, 100)), int(rng.integers(1, 4))) for r in range(70) for c in range(90) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "row int, col int, f int, l int, z double, s int").cache()


def dense(px, name, shape=(70, 90), fill=np.nan):
    out = np.full(shape, fill)
    for r in px.select("row", "col", name).collect():
        out[r.row, r.col] = fill if r[name] is None else r[name]
    return out


@pytest.mark.parametrize("tile", [16, 512])
def test_windows_slopes_and_distances_on_sparse_tables(px, tile, monkeypatch):
    monkeypatch.setattr(N.halo_tiles, "__defaults__", (tile,))
    n = np.nan_to_num(dense(px, "f"))
    pad = np.pad(n, 3)
    want = sum(pad[3 + a : 73 + a, 3 + b : 93 + b] for a in range(-3, 4) for b in range(-3, 4))
    got = {(r.row, r.col): r.f for r in N.box_sums(px, ["f"], 3).collect()}
    assert len(got) == px.count() and all(got[k] == want[k] for k in got)
    z = dense(px, "z")
    for r in N.slope(px, "z", 10.0).collect():
        w = z[r.row - 1 : r.row + 2, r.col - 1 : r.col + 2]
        x = w[0, 2] + 2 * w[1, 2] + w[2, 2] - w[0, 0] - 2 * w[1, 0] - w[2, 0]
        y = w[2, 0] + 2 * w[2, 1] + w[2, 2] - w[0, 0] - 2 * w[0, 1] - w[0, 2]
        assert abs(r.slope - np.degrees(np.arctan(np.hypot(x, y) / 80))) < 1e-9
    assert N.slope(px, "z", 10.0).count() == sum(not np.isnan(z[a - 1 : a + 2, b - 1 : b + 2]).any() for a in range(1, 69) for b in range(1, 89))


def test_local_rates_are_coded_from_two(spark):
    t = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 1, 1), (5, 5, 1, 0), (9, 9, 0, 0)], "row int, col int, f int, l int")
    got = {(r.row, r.col): r.ldefrate for r in N.local_rate(t, F.col("f") == 1, F.col("l") == 1, 3, 5.0).collect()}
    code = int(np.floor(2 + ((1 - 0.5**0.2) * 1e6 - 1) * 65533 / 999999))
    assert got == {(0, 0): code, (0, 1): code, (5, 5): 2, (9, 9): 0}


def test_exact_quantiles_and_positions(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), strict=True)] + [(7, None), (8, 5.0)]
    t = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r._q0, r._q1) for r in K.quantiles(t, "v", [0.025, 0.5], ["g"]).collect()}
    for g in (0, 1, 2, 8):
        v = [x for k, x in rows if k == g]
        assert np.allclose(got[g], np.percentile(v, [2.5, 50]))
    assert 7 not in got and np.allclose(K.quantiles(t, "v", [0.98]).first()[0], np.percentile([x for _, x in rows if x is not None], 98))
    assert K.quantiles(t.filter("false"), "v", [0.5]).collect() in ([], [(None,)])
    at = K.positions(spark.range(300).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 301).alias("o")), ["g"], "o").collect()
    for g in range(7):
        own = sorted((r.o, r._at) for r in at if r.g == g)
        assert [p for _, p in own] == list(range(len(own)))


def test_design_is_frozen_and_unseen_levels_raise(spark, px):
    spec = DE.from_roles("l", {"z": "continuous", "s": "categorical"}, {"s": (1, 2, 3)})
    assert spec.formula() == "I(l) + trial ~ scale(z) + C(s, levels=[1, 2, 3])" and spec.formula(False).endswith("C(s)")
    spec, coefs = DE.fitted(px, spec)
    t = px.toPandas()
    x = np.c_[(t["s"] == 2), (t["s"] == 3), (t["z"] - t["z"].mean()) / t["z"].std(ddof=0)].astype(float)
    beta = np.array([coefs[k] for k in spec.terms()])
    p = 1 / (1 + np.exp(-(coefs["Intercept"] + x @ beta)))
    assert abs((t["l"] - p).sum()) < 1e-2 and np.abs(x.T @ (t["l"] - p) - beta).max() < 1e-2  # the ridge objective is solved
    got = DE.applied(px, spec, coefs).toPandas().sort_values(["row", "col"])["p"].to_numpy()
    order = t.sort_values(["row", "col"]).index
    assert np.allclose(got, p[order])
    odd = px.withColumn("s", F.when(F.col("row") == 3, 9).otherwise(F.col("s")))
    assert [(r.variable, r.value) for r in spec.unseen(odd).collect()] == [("s", 9.0)]
    with pytest.raises(ValueError):
        DE.fitted(odd, spec)
    with pytest.raises(Exception, match="no level"):
        DE.applied(odd, spec, coefs).collect()
    for roles, levels in (({}, {}), ({"s": "categorical"}, {})):
        with pytest.raises(ValueError):
            DE.from_roles("l", roles, levels)
    s = DE.fit_statistics(px, spec, coefs).first()
    assert (s.n_rows, s.n_events) == (len(t), t["l"].sum()) and s.deviance < s.null_deviance


def test_window_and_class_models(spark):
    rows = [(r, c, 1, int((r * 7 + c) % 5 == 0), float(30 * (r + 1)), c % 2 + 1) for r in range(20) for c in range(30)]
    t = spark.createDataFrame(rows, "row int, col int, forest int, loss int, dist double, subj int")
    m = WF.window_fit(t, "dist", "loss", 5, 0.09, (3,), 52.0, 5000.0)
    assert m.dist_thresh == 330.0 and m.perc_thresh == 55.0
    risk, rates = WF.window_apply(WF.local_rates(t, m, 3, "forest", "loss"), t, m, "dist", "forest", "loss", 5, 0.09)
    assert {r.risk for r in risk.filter("row > 10").collect()} == {1} and risk.filter("row <= 10 AND risk < 2").count() == 0
    assert rates.agg(F.sum("nfor")).first()[0] == 600
    with pytest.raises(ValueError):
        WF.local_rates(t, m, 5, "forest", "loss")
    with pytest.raises(ValueError):
        WF.window_fit(t.withColumn("loss", F.col("loss") * 2), "dist", "loss", 5, 0.09)
    c = WF.class_fit(t, "dist", "loss", 30.0, 0.09, 52.0)
    assert len(c.edges) == 30 and c.edges[0] == 30.0 and c.edges[-1] == 330.0 and np.allclose(np.diff(np.log(c.edges)), np.log(11) / 29)
    own = WF.class_apply(t, c, "dist", "forest", "loss", "subj", 5, 0.09)[1]
    model = own.filter("cat <> 1001").select("cat", (F.col("rate_mod") * 2).alias("rate_mod"))
    other = {r.cat: r for r in WF.class_apply(t, c, "dist", "forest", "loss", "subj", 5, 0.09, model)[1].collect()}
    assert other[1001].rate_mod is None and other[1001].defor_dens is None  # a class that the model lacks
    known = [r for r in other.values() if r.cat != 1001]
    total = sum(r.ndefor for r in other.values()) / sum(r.nfor * r.rate_mod for r in known)
    assert all(abs(r.rate_abs - r.rate_mod * total) < 1e-12 for r in known)


def test_allocation_refuses_what_does_not_fit(spark):
    grid = GridSpec("E", 0.0, 800.0, 100.0, 100.0, 8, 8)
    t = spark.createDataFrame([(r, c, 2 if r < 4 else 3) for r in range(8) for c in range(8)], "row int, col int, risk int")
    rates = spark.createDataFrame([(2, 200, 0.001, 1.0), (3, 300, 0.003, 1.0)], "cat long, nfor long, rate_mod double, pixel_area double")
    ring = lambda x0, y0, x1, y1: [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]
    area = lambda *b: spark.createDataFrame([(1, "Polygon", ring(*b))], "feature_id long, kind string, rings array<array<array<double>>>")
    got = {r.period: r.deforestation for r in WF.allocate(t, rates, area(10.0, 410.0, 190.0, 790.0), 1000.0, 4, grid).collect()}
    assert abs(got["annual"] - 8 * 0.001 * 1000 / 1.1 / 4) < 1e-9 and abs(got["entire"] - 4 * got["annual"]) < 1e-9
    for bad in ((rates.filter("cat = 9"), area(0.0, 0.0, 100.0, 100.0)), (rates, area(5000.0, 0.0, 6000.0, 100.0)), (rates.withColumn("pixel_area", F.lit(2.0)), area(0.0, 0.0, 100.0, 100.0)),
                (rates.withColumn("cat", F.col("cat") + 100), area(0.0, 0.0, 100.0, 100.0)), (rates, area(0.0, 0.0, 100.0, 100.0).filter("false"))):
        with pytest.raises(ValueError):
            WF.allocate(t, bad[0], bad[1], 1000.0, 4, grid)


def test_draws_repeat_and_keep_their_order(spark, px):
    grid = GridSpec("E", 0.0, 700.0, 10.0, 10.0, 70, 90)
    draw = lambda **k: [tuple(r) for r in P.in_draw_order(P.points(px, "l", grid, **k)).collect()]
    a = draw(strategy="random", n=50, seed=4)
    assert a == draw(strategy="random", n=50, seed=4) != draw(strategy="random", n=50, seed=5)
    assert len({r[2:4] for r in a}) == 50 and sorted(r[0] for r in a) == list(range(50))
    s = draw(strategy="stratified", n=60, allocation="each", seed=4)
    assert [r[1] for r in s] == [1] * 60 + [0] * 60 and [r[0] for r in s] == 2 * list(range(60)) and len({r[2:4] for r in s}) == 120
    assert all((x, y) == (10 * (c + 0.5), 700 - 10 * (r + 0.5)) for _, _, r, c, x, y in s)
    assert len(draw(strategy="random", n=10**6)) == px.count() and {r[0] for r in draw(strategy="random", n=10**6)} == {None}
    have = {(r.row, r.col) for r in px.collect()}
    assert {r[2:4] for r in draw(strategy="systematic", spacing=38.0)} == {k for k in have if k[0] % 4 == 0 and k[1] % 4 == 0}
    for bad in ({"strategy": "random"}, {"strategy": "systematic"}, {"strategy": "systematic", "spacing": 0.0}, {"strategy": "other", "n": 5}):
        with pytest.raises(ValueError):
            P.points(px, "l", grid, **bad)


def test_extraction_on_grids_of_their_own(spark):
    fine = spark.createDataFrame([(r, c, r * 10 + c) for r in range(4) for c in range(4)], "row int, col int, a int")
    coarse = spark.createDataFrame([(0, 0, 1), (0, 1, None), (1, 0, 3), (1, 1, 4)], "row int, col int, b int")
    g1, g2 = GridSpec("E", 0.0, 4.0, 1.0, 1.0, 4, 4), GridSpec("E", 0.0, 4.0, 2.0, 2.0, 2, 2)
    at = spark.createDataFrame([(0.5, 3.5), (3.9, 3.9), (0.0, 0.1), (4.0, 1.0), (2.0, 2.0)], "x double, y double")
    got = sorted(tuple(r) for r in P.extract_at(at, g1, [(fine, g1, ["a"]), (coarse, g2, ["b"])]).collect())
    assert got == [(0, 1, 0, 1), (22, 4, 10, 1), (30, 3, 12, 1)]  # no value; outside


def test_sinks_replace_only_when_they_succeed(spark, tmp_path):
    path = str(tmp_path / "layer")
    good = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, value double")
    IO.write_layer(good, path)
    with pytest.raises(Exception, match="boom"):
        IO.write_layer(good.withColumn("value", F.raise_error(F.lit("boom")).cast("double")), path)
    assert [r.value for r in IO.read_layer(spark, path).collect()] == [1.0]
    IO.write_layer(good.withColumn("value", F.lit(2.0)), path)
    assert [r.value for r in IO.read_layer(spark, path).collect()] == [2.0]
    IO.write_csv(spark.createDataFrame([("annual", 1, 0.25), ("entire", 4, 1.05)], "period string, length int, deforestation double"), str(tmp_path / "a"), "allocation")
    assert [tuple(r) for r in IO.read_csv(spark, str(tmp_path / "a"), "allocation").orderBy("period").collect()] == [("annual", 1, 0.2), ("entire", 4, 1.0)]
    many = spark.range(300).select(F.col("id").alias("feature_id"), F.lit(None).cast("array<array<array<double>>>").alias("rings"))
    with pytest.raises(ValueError):
        IO.rasterize(many, 1, 0.0, 0.0, 1.0, 1, unique=True)


def test_derived_layers(spark):
    years = spark.createDataFrame([(1900,), (1977,), (1978,), (2018,), (2100,)], "y int")
    assert [r[0] for r in years.select(D.closest_epoch(F.col("y"))).collect()] == [1975, 1975, 1980, 2020, 2020]
    assert years.limit(1).select(D.closest_epoch(F.lit(1990), (1988, 1992))).first()[0] == 1988
    t = spark.createDataFrame([(15, 90), (14, 90), (15, None), (20, 100)], "p int, b int")
    assert [r[0] for r in t.select(D.settlement(F.col("p"), F.col("b"))).collect()] == [1, 0, 0, 1]
    c = spark.createDataFrame([(1,), (2,), (None,), (3,)], "c int")
    assert [tuple(r) for r in c.select(D.water(F.col("c")), D.undisturbed(F.col("c"))).collect()] == [(0, 1), (1, 0), (0, None), (1, 0)]


def test_harmonise_redoes_what_is_not_current(spark):
    kind = "name string, year int, data_type string, raster_type string, method string, active boolean, modified_at int"
    raw = spark.createDataFrame([(n, None, "raster", "continuous", None, True, 1) for n in ("b", "a", "done")], kind)
    out = spark.createDataFrame([("done", None, "continuous", None, "g", "p", 2)], "name string, year int, raster_type string, levels array<double>, grid_signature string, path string, modified_at int")
    made = {}
    keys = WF.harmonise(raw, out, "g", lambda k: (spark.range(1), f"/{k}"), lambda path, px: made.update({path: px.count()}), order=["b"])
    assert keys == ["b", "a"] and made == {"/b": 1, "/a": 1}


def test_means_at_a_tie_do_not_depend_on_the_order_of_rows(spark):
    """Means of hundredths whose distance to 273.15 ends in .5: the last bit of the sum decides."""
    rnd, rows, want = np.random.default_rng(9), [], {}
    for g in range(150):
        n = 60 + g % 25
        cents = rnd.integers(0, 15000, n)
        cents[0] += (65 * n - int(cents.sum())) % (100 * n)
        values = [int(c) / 100 for c in cents]
        rows += [(g, v) for v in values]
        mean = math.fsum(values) / n - 273.15
        want[g] = int(math.copysign(math.floor(abs(mean) + 0.5), mean))
    df = spark.createDataFrame(rows, "g long, value double")
    for dealt in (df.coalesce(1), df.repartition(7), df.sort("value"), df.sort(F.desc("value"))):
        assert {r.g: r.mean for r in D.year_of_climate(dealt, "value", ("g",)).collect()} == want
