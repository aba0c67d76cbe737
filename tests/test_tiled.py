import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import evaluation as EV
from pixelweave.operators import resample as RS
from pixelweave.operators import tiles as TI
from pixelweave.sources import tiled as TL
from pixelweave.sources import versions as V


def grid(spark, height=70, width=50):
    at = spark.range(height * width)
    return at.select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("value"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stacking_written_layers_needs_no_exchange(spark, tmp_path):
    a, b = grid(spark), grid(spark).filter("col % 3 = 0").withColumn("value", F.col("value") / 2.0)
    TL.write_tiles(a, f"{tmp_path}/a", 16, 4)
    TL.write_tiles(b, f"{tmp_path}/b", 16, 4)
    layers = {n: TL.read_tiles(spark, f"{tmp_path}/{n}") for n in "ab"}
    got = TL.stack_tiles(layers)
    assert "Exchange" not in plan(got) and "SortMergeJoin" in plan(got) and got.dtypes == [("row", "int"), ("col", "int"), ("a", "bigint"), ("b", "double")]
    want = {(r.row, r.col): (r.value, None if r.value is None else r.value / 2) for r in a.collect() if r.col % 3 == 0}
    assert {(r.row, r.col): (r.a, r.b) for r in got.collect()} == want
    sums = TL.map_stacked(layers, lambda t: pd.DataFrame({"n": [len(t)], "s": [float(t["a"].sum())]}), "n long, s double")
    assert "Exchange" not in plan(sums)
    assert sums.agg(F.sum("n"), F.sum("s")).first() == (len(want), float(sum(x or 0 for x, _ in want.values())))


def test_a_row_range_reads_less(spark, tmp_path):
    TL.write_tiles(grid(spark, 600, 40), str(tmp_path), 8, 2)
    layer = TL.read_tiles(spark, str(tmp_path))
    some = layer.rows(100, 110)
    assert {(r.row, r.col) for r in some.pixels().collect()} == {(r, c) for r in range(96, 112) for c in range(40)}

    def scanned(df):
        df.collect()
        node = df._jdf.queryExecution().executedPlan()
        while node.children().size():
            node = node.children().head()
        return node.metrics().get("numOutputRows").get().value()

    assert scanned(layer.tiles.select("_tile").filter("_tile IS NOT NULL")) == 75 * 5
    assert scanned(some.tiles.select("_tile")) <= 2 * 2 * 16  # row groups of 16 tiles, at most two a bucket


def test_a_failed_write_leaves_the_layer(spark, tmp_path):
    path = str(tmp_path)
    TL.write_tiles(grid(spark, 9, 9), path, 4, 2)
    bad = grid(spark, 9, 9).withColumn("value", F.raise_error(F.lit("boom")).cast("long"))
    with pytest.raises(Exception, match="boom"):
        TL.write_tiles(bad, path, 4, 2)
    assert TL.read_tiles(spark, path).pixels().count() == 81 and len(V.versions(spark, path)) == 1
    TL.write_tiles(grid(spark, 5, 9), path, 4, 2)
    assert TL.read_tiles(spark, path).pixels().count() == 45 and len(V.versions(spark, path)) == 1
    with pytest.raises(FileNotFoundError):
        TL.read_tiles(spark, f"{path}/none")


def test_layers_of_different_sides_do_not_stack(spark, tmp_path):
    for side in (4, 8):
        TL.write_tiles(grid(spark, 5, 5), f"{tmp_path}/{side}", side, 2)
    with pytest.raises(ValueError, match="one side"):
        TL.stack_tiles({str(s): TL.read_tiles(spark, f"{tmp_path}/{s}") for s in (4, 8)})


@pytest.mark.parametrize(("factor", "shift"), [(3.0, (0.0, 0.0)), (0.4, (0.0, 0.0)), (25.0, (0.3, -0.7)), (1.0, (0.0, 0.5)), (2.5, (-3.0, 4.0)), (0.05, (0.0, 0.0))])
@pytest.mark.parametrize("bilinear", [False, True])
def test_regrid_equals_the_formula(spark, factor, shift, bilinear):
    rnd = np.random.default_rng(2)
    z = np.where(rnd.random((40, 30)) < 0.2, np.nan, rnd.random((40, 30)))
    there = rnd.random(z.shape) < 0.9
    px = spark.createDataFrame([(int(r), int(c), None if np.isnan(z[r, c]) else float(z[r, c])) for r, c in zip(*np.nonzero(there), strict=True)], "row int, col int, v double")
    target = spark.range(61 * 43).select(F.floor(F.col("id") / 43 - 5).cast("int").alias("row"), (F.col("id") % 43 - 4).cast("int").alias("col"))
    at = lambda r, c: z[r, c] if 0 <= r < 40 and 0 <= c < 30 and there[r, c] and not np.isnan(z[r, c]) else None
    want = {}
    for r in range(-5, 56):
        for c in range(-4, 39):
            y, x = (r + 0.5) / factor + shift[0], (c + 0.5) / factor + shift[1]
            if not bilinear:
                want[r, c] = at(int(np.floor(y)), int(np.floor(x)))
                continue
            r0, c0 = int(np.floor(y - 0.5)), int(np.floor(x - 0.5))
            fr, fc = y - 0.5 - r0, x - 0.5 - c0
            four = [(at(r0 + a, c0 + b), (fr if a else 1 - fr) * (fc if b else 1 - fc)) for a in (0, 1) for b in (0, 1)]
            known = sum(w for v, w in four if v is not None)
            want[r, c] = sum(v * w for v, w in four if v is not None) / known if known > 0 else None
    got = {(r.row, r.col): r.v for r in RS.regrid(px, target, "v", factor, bilinear, shift, tile=8).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (w is None) and (w is None or abs(got[k] - w) < 1e-9) for k, w in want.items())


def test_scan_folds_in_order_and_by_band(spark):
    px = grid(spark, 64, 20).repartition(9, "row").sortWithinPartitions("row")
    one = TI.scan(px, lambda t: t["value"].sum(), lambda a, b: a + b, lambda s: pd.DataFrame({"s": [s]}), "s double").collect()
    want = px.agg(F.sum("value")).first()[0]
    assert [r.s for r in one] == [want]
    bands = TI.scan(px, lambda t: (len(t), t["row"].max()), lambda a, b: (a[0] + b[0], max(a[1], b[1])), lambda s: pd.DataFrame({"n": [s[0]], "top": [s[1]]}), "band long, n long, top long", band=10)
    assert sorted(tuple(r) for r in bands.collect()) == [(b, 200 if b < 6 else 80, min(10 * b + 9, 63)) for b in range(7)]
    tiles = TI.scan(px, lambda t: {(int(t["row"].iloc[0]) // 16, int(t["col"].iloc[0]) // 16)}, lambda a, b: a | b, lambda s: pd.DataFrame({"n": [len(s)]}), "n long", tile=16)
    assert tiles.first().n == 8
    # Joining texts is associative but not commutative: the order is that of the partitions.
    ordered = px.repartitionByRange(7, "row").sortWithinPartitions("row", "col")
    text = TI.scan(ordered, lambda t: [int(r) for r in t["row"].unique()], lambda a, b: a + b, lambda s: pd.DataFrame({"r": s}), "r long")
    assert [r.r for r in text.collect()] == list(range(64))
    assert TI.scan(px.limit(0), len, lambda a, b: a + b, lambda s: pd.DataFrame({"n": [s]}), "n long").collect() == []


def test_evaluation_of_two_datasets_equals_a_loop(spark):
    rnd = np.random.default_rng(6)
    rows = [(r, c, int(rnd.random() < 0.8), int(rnd.random() < 0.2), int(rnd.integers(0, 6))) for r in range(24) for c in range(30)]
    px = spark.createDataFrame(rows, "row int, col int, forest int, loss int, risk int").withColumn("loss", F.when(F.col("forest") == 1, F.col("loss")))
    other = px.filter("row < 20").withColumn("loss", F.when(F.col("forest") == 1, (F.col("col") % 4 == 0).cast("int")))
    half = px.filter("col > 2").select("row", "col", (F.col("risk") * 3).alias("value"))
    runs = [EV.Run(px, {"a": F.col("risk")}, 30, 5, 0.09, "p", "t", "forest", "loss"), EV.Run(other, {"b": half, "a": 7 - F.col("risk")}, 30, 2, 1.0, "q", "u", "forest", "loss")]
    got = {(r.prediction, r.period, r.csize): r for r in EV.evaluate(runs, [6, 8, 30]).collect()}
    assert len(got) == 9
    rate = lambda k: 0.0 if k == 1 else ((k - 2) * 999999 / 65533 + 1) * 1e-6
    p1, p2 = px.toPandas(), other.toPandas()
    b = p2.merge(half.toPandas(), on=["row", "col"]).assign(cat=lambda t: t["value"])
    for (name, period), frame, years, area in ((("a", "p"), p1.assign(cat=p1["risk"]), 5, 0.09), (("b", "q"), b, 2, 1.0), (("a", "q"), p2.assign(cat=7 - p2["risk"]), 2, 1.0)):
        pop, ev = (frame["forest"] == 1) | (frame["loss"] == 1), frame["loss"] == 1
        by = {k: (pop[frame["cat"] == k].sum(), ev[frame["cat"] == k].sum()) for k in frame["cat"].unique() if k > 0}
        adjust = sum(d for _, d in by.values()) / sum(n * rate(k) for k, (n, _) in by.items())
        dens = frame["cat"].map(lambda k: rate(k) * adjust * area / years if k > 0 else 0.0)
        for csize in (6, 8, 30):
            cells = pd.DataFrame({"cell": frame["row"] // csize * 100 + frame["col"] // csize, "n": pop * area, "o": ev * area, "p": dens * years}).groupby("cell").sum().query("n > 0")
            e, r = cells["p"] - cells["o"], got[name, period, csize]
            assert r.ncell == len(cells) and np.isclose(r.RMSE, np.sqrt((e**2).mean())) and np.isclose(r.wRMSE, np.sqrt((cells["n"] * e**2).sum() / cells["n"].sum()))
            assert np.isclose(r.MedAE, e.abs().median()) and (len(cells) < 3 or np.isclose(r.R2, np.corrcoef(cells["p"], cells["o"])[0, 1] ** 2))
