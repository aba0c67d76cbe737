import pytest
from pyspark.sql import functions as F

from pixelweave.functions import names as NA
from pixelweave.functions import scalars as S
from pixelweave.grid import GridSpec
from pixelweave.operators import catalog as C
from pixelweave.operators import imports as I
from pixelweave.operators import rates as R
from pixelweave.operators import summaries as U


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_utm_zones_at_their_bounds(spark):
    places = {(10, 84): 5041, (10, -80): 5042, (10, -79.9): 32732, (5.9, 60): 32632, (6, 60): 32632, (2, 60): 32631, (2.1, 55): 32631, (2.1, 64): 32631, (8, 72): 32631, (8, 71): 32632,
              (10, 72): 32633, (20, 72): 32633, (15, 72): 32633, (22, 72): 32635, (31, 72): 32635, (40, 72): 32637, (180, 0): 32661, (-180, -1): 32701}
    df = spark.createDataFrame([(float(x), float(y), v) for (x, y), v in places.items()], "x double, y double, v int")
    assert df.filter(S.utm_epsg(F.col("x"), F.col("y")) != F.col("v")).collect() == []


def test_terms_labels_and_keys(spark):
    t = F.lit("C(subj, levels=['a', 'b'])[T.b]")
    assert tuple(one(spark, NA.term_variable(t), NA.term_level(t), NA.reference_level(t))) == ("subj", "b", "a")
    assert tuple(one(spark, NA.term_variable(F.lit("scale(alt)")), NA.term_level(F.lit("scale(alt)")), NA.term_variable(F.lit("C(pa)")), NA.reference_level(F.lit("C(pa)[T.1]")))) == ("scale(alt)", None, "pa", None)
    assert one(spark, NA.term_variable(F.lit("C(a + b)"))).c0 == "C(a + b)" and one(spark, NA.term_level(F.lit("a[T.1]"))).c0 is None
    null = F.lit(None).cast("string")
    assert tuple(one(spark, NA.design_label(F.lit("random"), null, null), NA.design_label(null, null, null), NA.design_label(F.lit("s"), F.lit("equal"), F.lit("n")))) == ("random", None, "s, equal (n)")
    assert tuple(one(spark, NA.prediction_key(F.lit("m"), F.lit("d"), F.lit(2020), F.lit(5)), NA.prediction_group(null, F.lit("m"), F.lit("d")))) == ("m__d_y2020_w5", "m__d")
    assert [one(spark, NA.cell_sizes(F.lit(x))).c0 for x in ("100, 300 100", "", "1.5", "0", "-3", "12 x")] == [[100, 300], None, None, None, None, None]


def test_file_names(spark):
    a, b, c = (F.lit(f"/d/YARI_forest_gfc_10_{y}.tif") for y in (2020, 2015, 2024))
    assert one(spark, NA.change_file(a, b, "loss")).c0 == "/d/YARI_loss_gfc_10_20152020.tif"
    assert one(spark, NA.stack_file(a, b, c, "stack")).c0 == "/d/YARI_stack_gfc_10_2020_2015_2024.tif"
    assert one(spark, NA.change_file(F.lit("x_2001.tif"), F.lit("x_2002.tif"), "gain")).c0 == "x_gain_20012002.tif"
    got = one(spark, NA.model_and_period(F.lit("/e/indices_mw_11_validation_300.csv")), NA.model_and_period(F.lit("indices_glm_historical.csv")))
    assert (tuple(got.c0), tuple(got.c1)) == (("validation", "mw_11"), ("historical", "glm"))


def test_token_lookup_takes_tokens_literally(spark):
    rows = [(1, "/d/a_v1.2_x.tif"), (2, "/d/a_v1x2_x.tif"), (3, "/d/forestry_2015.tif"), (4, "/d/a(b_2015.tif")]
    files = spark.createDataFrame(rows, "id int, path string")
    find = lambda *a, **k: sorted(r.id for r in C.files_with_tokens(files, *a, **k).collect())
    assert find(["v1.2"]) == [1] and find(["a(b"]) == [4] and find(["forest"]) == [] and find(["2015", "x"], any_of=False) == []
    assert find(["15"]) == [3, 4] and find([], ["x"]) == [3, 4] and find([]) == [1, 2, 3, 4]
    assert C.files_with(files, [], []).count() == 4 and C.files_with(files, [], [], match_all=False).count() == 0


def test_rate_table_contract(spark):
    kind = "cat double, nfor double, rate_mod double, pixel_area double"
    good = [(1.0, 10.0, 0.1, 0.09), (2.0, 5.0, 0.2, 0.09)]
    R.require_rate_table(spark.createDataFrame(good, kind))
    bad = {
        "not_whole": (1.5, 1.0, 0.1, 0.09), "not_positive": (0.0, 1.0, 0.1, 0.09), "repeated": (2.0, 1.0, 0.1, 0.09), "not_finite": (3.0, float("inf"), 0.1, 0.09),
        "negative": (3.0, -1.0, 0.1, 0.09), "areas_differ": (3.0, 1.0, 0.1, 0.08),
    }
    for name, row in bad.items():
        with pytest.raises(ValueError, match=name):
            R.require_rate_table(spark.createDataFrame([*good, row], kind))
    with pytest.raises(ValueError, match="missing_columns"):
        R.require_rate_table(spark.createDataFrame(good, kind).drop("nfor"))
    with pytest.raises(ValueError, match="no_area"):
        R.require_rate_table(spark.createDataFrame([(1.0, 1.0, 0.1, 0.0)], kind))
    with pytest.raises(ValueError, match="no_risk"):
        R.require_rate_table(spark.createDataFrame([(1.0, 0.0, 0.1, 0.09)], kind))
    with pytest.raises(ValueError):
        R.require_threshold(spark.createDataFrame([(30.0, 50.0)], "distance double, perc double"), 60.0)


def test_checks_of_layers(spark):
    px = lambda *v: spark.createDataFrame([(x,) for x in v], "v double")
    for values, ok in (((0.0, 1.0), True), ((0.0, 1.0, 2.0), False), ((0.0, 255.0), False), ((0.0, 0.0), False), ((None,), False)):
        assert U.binary_check(px(*values), "v").first().valid == ok
    scale = lambda s, *v: I.scale_faults(px(*v), "v", s).first().fault
    assert [scale("probability", 0.0, 1.0), scale("probability", 0.0, 1.1), scale("risk", 0.0, 1.0), scale("risk", 1.0, 70000.0), scale("risk", -1.0, 5.0), scale("risk", 3.0, 3.0), scale("risk", None)] == [
        None, "above 1", "a probability map", "above 65535", "negative values", "constant", "no values"]
    with pytest.raises(ValueError):
        I.require_scale(px(0.0, 2.0), "v", "other")
    with pytest.raises(ValueError):
        I.inspect(spark.createDataFrame([("a",)], "v string"), "v", GridSpec("E", 0.0, 0.0, 1.0, 1.0, 1, 1))
    with pytest.raises(ValueError):
        I.inspect(px(1.0), "v", None)
    b = spark.createDataFrame([("Polygon", [[[0.0, 0.0]]]), ("Point", [[[0.0, 0.0]]]), ("Polygon", None)], "kind string, rings array<array<array<double>>>")
    assert tuple(U.border_faults(b).first()) == (0, 1, 1) and tuple(U.border_faults(b.filter("false")).first()) == (1, 0, 0)
    for part, word in ((b.filter("false"), "no features"), (b.filter("rings is null"), "no geometry"), (b.filter("kind = 'Point'"), "no polygons")):
        with pytest.raises(ValueError, match=word):
            U.require_borders(part)
    d = U.class_domain(px(1.0, 2.0, 2.0, None), "v").first()
    assert (d.n_values, d.n_not_whole, d.valid) == (2, 0, True) and not U.class_domain(px(None), "v").first().valid
    with pytest.raises(Exception, match="whole numbers"):
        U.class_table(px(1.0, 1.5), "v").collect()


def test_axis_bounds_of_flat_values(spark):
    def bounds(*rows):
        return tuple(U.axis_bounds(spark.createDataFrame(list(rows), "x double, y double"), "x", "y").first())

    assert bounds((1.0, 2.0), (float("nan"), 5.0)) == (1.0, 5.0) and bounds((None, None)) == (0.0, 1.0) and bounds((0.0, 0.0)) == (0.0, 1.0)
    assert bounds((3.0, 3.0)) == (0.0, 6.0) and bounds((-2.0, None)) == (-4.0, 0.0) and bounds((float("inf"), 1.0)) == (0.0, 2.0)


def test_change_by_keys_and_datasets(spark):
    rows = [("f", 2015, "raster", "g", "a"), ("f", 2020, "raster", "g", "b"), ("f", 2024, "raster", "h", "c"), ("s", None, "raster", "g", "d"), ("loss_f_2015_2020", None, "raster", "g", "made")]
    c = spark.createDataFrame(rows, "name string, year int, data_type string, grid_signature string, path string")
    assert C.change_entry(c, "gain", "f_2015", "f_2020") == {"name": "gain_f_2015_2020", "sources": ("a", "b"), "years": (2015, 2020), "existing": None}
    assert C.change_entry(c, "loss", "f_2015", "f_2020")["existing"] == "made"
    for bad in (("swap", "f_2015", "f_2020"), ("loss", "f_2015", "f_2015"), ("loss", "f_2020", "f_2015"), ("loss", "f_2015", "f_2024"), ("loss", "s", "f_2020"), ("loss", "x", "f_2020")):
        with pytest.raises(ValueError):
            C.change_entry(c, *bad)
    assert C.lookup(c, "s").count() == 1 and C.lookup(c, "f").count() == 0 and C.lookup(c, "f", 2020).first().path == "b"
    got = [(r.role, r.year, r.path) for r in C.resolve(c, ("f", 2020), ["s"]).orderBy("position").collect()]
    assert got == [("target", 2020, "b"), ("feature", None, "d")]
    for target, features, years in ((("f", None), ["s"], {}), (("f", 2016), ["s"], {}), (("s", 2020), [], {}), (("f", 2020), ["s"], {"s": 2020}), (("x", None), [], {})):
        with pytest.raises(ValueError):
            C.resolve(c, target, features, years)


def test_harmonisation_rules(spark):
    raw = [("ok", 1), ("new", 1), ("type", 1), ("levels", 1), ("old", 1), ("grid", 1), ("unknown", 1), ("one", 1), ("two", 1)]
    r = spark.createDataFrame([(n, None, "raster", "categorical" if n in ("type", "levels") else "continuous", None, True, 10) for n, _ in raw] + [("off", None, "vector", None, "unique", False, 1), ("ids", None, "vector", None, "unique", True, 1)],
        "name string, year int, data_type string, raster_type string, method string, active boolean, modified_at int")
    out = [(n, None, "categorical" if n in ("levels", "ids") else "continuous", [1.0] if n == "ids" else None, None if n == "unknown" else "old" if n == "grid" else "g", "shared" if n in ("one", "two") else n, 5 if n == "old" else 20) for n in ("ok", "type", "levels", "old", "grid", "unknown", "one", "two", "ids")]
    p = spark.createDataFrame(out, "name string, year int, raster_type string, levels array<double>, grid_signature string, path string, modified_at int")
    got = {x.key: x.status for x in C.harmonisation(r, p, "g").collect()}
    assert got == {"ok": "current", "ids": "current", "unknown": "unknown", **dict.fromkeys(("new", "type", "levels", "old", "grid", "one", "two"), "pending")}
    assert {x.status for x in C.harmonisation(r, p, None).filter("key <> 'new'").collect()} == {"unknown"}
