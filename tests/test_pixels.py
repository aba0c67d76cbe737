import random

from pyspark.sql import functions as F

from pixelweave.functions import names as NA
from pixelweave.functions import scalars as S
from pixelweave.operators import layers as L
from pixelweave.operators import rates as R
from pixelweave.operators import sampling as P
from pixelweave.sources import layers as IO


def test_change_truth_table(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (None, 1)], "a int, b int")
    got = df.select(L.change(F.col("a"), F.col("b"), "loss").alias("l"), L.change(F.col("a"), F.col("b"), "gain").alias("g")).collect()
    assert [r.l for r in got] == [0, 1, None, None, None]
    assert [r.g for r in got] == [None, None, 1, 0, None]


def test_risk_codes_and_names(spark):
    df = spark.createDataFrame([(0.2,), (0.8,), (0.0,)], "p double")
    assert [r.c for r in df.select(S.risk_code(F.col("p")).alias("c")).collect()] == [13107, 52428, 1]
    names = spark.createDataFrame([("forest_loss_2015_2020",), ("forest",)], "n string")
    assert [r.y for r in names.select(NA.years_in(F.col("n")).alias("y")).collect()] == [5, None]
    label = lambda n: NA.run_label(F.lit("mw_calib_a"), F.lit(5), F.lit(n))
    row = spark.range(1).select(label("val 2020!").alias("a"), label("!!!").alias("b")).first()
    assert (row.a, row.b) == ("MW_w5_val_2020", "MW_w5_mw_calib_a")


def test_sample_allocation(spark):
    equal = P.allocate_equal(spark.createDataFrame([(0, 10000), (1, 300)], "c int, n long"), 1000).collect()
    assert {r.c: r.n_alloc for r in equal} == {0: 500, 1: 300}
    prop = P.allocate_proportional(spark.createDataFrame([(0, 9000), (1, 1000)], "c int, n long"), 1000).collect()
    assert {r.c: r.n_alloc for r in prop} == {0: 900, 1: 100}
    sizes = spark.createDataFrame([(500_000,), (30_000_000,), (100_000_000,)], "a long").select(P.adaptive_size(F.col("a"), 1.0).alias("s")).collect()
    assert [r.s for r in sizes] == [10_000, 30_000, 50_000]


def test_allocated_hectares(spark):
    counts = spark.createDataFrame([(2, 8), (3, 8)], "cat long, npix long")
    rates = spark.createDataFrame([(2, 200, 0.001), (3, 300, 0.003)], "cat long, nfor long, rate_mod double")
    got = {r.period: r.deforestation for r in R.allocation(counts, rates, 1000.0, 4, 1.0).collect()}
    annual = (8 * 0.001 + 8 * 0.003) * (1000 / 1.1) / 4
    assert abs(got["annual"] - annual) < 1e-9 and abs(got["entire"] - 4 * annual) < 1e-9


def test_rasterize_square_with_hole(spark):
    rings = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]]
    shape = spark.createDataFrame([(1, rings)], "feature_id long, rings array<array<array<double>>>")
    got = {(r.row, r.col) for r in IO.rasterize(shape, 5, 0.0, 5.0, 1.0, 5).collect()}
    assert got == {(r, c) for r in range(1, 5) for c in range(4) if not (r in (2, 3) and c in (1, 2))}


def test_binary_round_is_that_of_the_exact_value(spark):
    rnd = random.Random(1)
    values = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 0.0, 1e300, 5e-324, 2.5, 1e15 + 0.3, 0.285, None]
    values += [rnd.uniform(-1000, 1000) for _ in range(3000)] + [k / 1000 for k in range(-2000, 2000)] + [k / 8 for k in range(-99, 99)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 6):
        got = df.select("v", S.binary_round(F.col("v"), digits).alias("r")).collect()
        assert all(r.r is None if r.v is None else r.r == round(r.v, digits) or abs(r.v) * 10**digits >= 2**52 for r in got)
