import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import geometry as GEO
from pixelweave.operators import sampling as P
from pixelweave.operators import workflows as WF
from pixelweave.sources import tiled as TL


def polygons(spark, shapes):
    rows = [(i, [[list(map(float, p)) for p in [*ring, ring[0]]] for ring in rings]) for i, rings in enumerate(shapes)]
    return spark.createDataFrame(rows, "feature_id long, rings array<array<array<double>>>")


def star(rnd, n=7, at=(0, 0), size=10):
    """A concave polygon around a point."""
    turn = np.sort(rnd.random(n)) * 2 * math.pi
    out = size * (0.2 + 0.8 * rnd.random(n))
    return [(at[0] + r * math.cos(a), at[1] + r * math.sin(a)) for a, r in zip(turn, out, strict=True)]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd


def cross(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    boxes = all(min(a[k], b[k]) <= max(c[k], d[k]) and min(c[k], d[k]) <= max(a[k], b[k]) for k in (0, 1))
    return boxes and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def sides(rings):
    return [(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]


def meet(f, g):
    return any(cross(*e, *h) for e, h in itertools.product(sides(f), sides(g))) or any(inside(*r[0], g) for r in f) or any(inside(*r[0], f) for r in g)


def shapes(seed, n, spread=60):
    rnd = np.random.default_rng(seed)
    out = []
    for i in range(n):
        at, size = rnd.random(2) * spread, (3, 8, 70)[i % 3]  # the last are long beside the squares
        rings = [star(rnd, 6, at, size)]
        if i % 4 == 0:
            rings = [[(at[0] - 9, at[1] - 9), (at[0] + 9, at[1] - 9), (at[0] + 9, at[1] + 9), (at[0] - 9, at[1] + 9)], star(rnd, 5, at, 5)]
        if i % 5 == 0:
            rings = [[tuple(at), (at[0] + 200, at[1] + 3), (at[0] + 1, at[1] + 2)]]
        out.append(rings)
    return out


@pytest.mark.parametrize("step", [2.0, 16.0, 500.0])
def test_meeting_of_concave_holed_and_slanted_shapes(spark, step):
    a, b = shapes(1, 60, 300), shapes(2, 16, 300)
    got = {r.feature_id for r in GEO.meeting(polygons(spark, a), polygons(spark, b), step).collect()}
    assert got == {i for i, f in enumerate(a) if any(meet(f, g) for g in b)} and 5 < len(got) < 60


def test_an_edge_walks_only_the_squares_that_it_crosses(spark):
    ends = [(0.3, 0.2, 1000.7, 700.1), (5.0, 5.0, 5.0, 95.0), (0.0, 7.5, 300.0, 7.5), (0.0, 0.0, 100.0, 100.0), (3.2, 3.2, 3.2, 3.2)]
    rows = [(i, [[[ax, ay], [bx, by]]]) for i, (ax, ay, bx, by) in enumerate(ends)]
    df = spark.createDataFrame(rows, "feature_id long, rings array<array<array<double>>>")
    got = {}
    for r in GEO.squares(df, 10.0).collect():
        got.setdefault(r.feature_id, []).append((r._sx, r._sy))
    for i, (ax, ay, bx, by) in enumerate(ends):
        assert len(got[i]) == len(set(got[i])) <= 3 * (abs(bx - ax) + abs(by - ay)) / 10 + 4
        for t in np.linspace(0, 1, 4001):
            assert (math.floor((ax + t * (bx - ax)) / 10), math.floor((ay + t * (by - ay)) / 10)) in got[i]
    assert len(got[0]) < 200  # of 101 * 71 squares of the bounding box


def test_levels_follow_needs_and_a_circle_raises():
    assert WF.dependency_levels(["b", "a", "c"], {"a": ["b"], "b": ["x"], "x": ["c"]}) == [["c"], ["b"], ["a"]]
    assert WF.dependency_levels(["b", "a"], {}) == [["a", "b"]]
    assert WF.dependency_levels([], {"a": ["b"]}) == []
    with pytest.raises(ValueError, match="a > b > c > a"):
        WF.dependency_levels(["a"], {"a": ["b"], "b": ["c"], "c": ["a"]})
    assert WF.outdated({"c"}, {"a": ["b"], "b": ["c"], "d": ["e"]}) == {"a", "b", "c"}


def grids(spark):
    at = spark.range(300 * 40).select(F.floor(F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), F.col("id").alias("value"))
    return at, at.withColumn("value", F.when(F.col("row") % 5 > 0, -F.col("value")))


def test_few_points_do_not_shuffle_the_layers(spark, tmp_path):
    a, b = grids(spark)
    wide = a.join(b.withColumnRenamed("value", "b"), ["row", "col"]).withColumnRenamed("value", "a")
    wide.repartition(3).write.parquet(f"{tmp_path}/wide")
    stored = spark.read.parquet(f"{tmp_path}/wide")
    points = spark.createDataFrame([(100, 3), (101, 4), (101, 4), (110, 1), (999, 999)], "row int, col int")
    got = P.extract(points, stored, ["a", "b"], 40)
    want = sorted([(101 * 40 + 4, -(101 * 40 + 4))] * 2)
    assert sorted((r.a, r.b) for r in got.collect()) == want
    assert "hashpartitioning" not in got._jdf.queryExecution().toString() and "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    layers = {}
    for n, df in (("a", a), ("b", b)):
        TL.write_tiles(df, f"{tmp_path}/{n}", 8, 2)
        layers[n] = TL.read_tiles(spark, f"{tmp_path}/{n}")
    tiled = P.extract_tiled(points.filter("row < 900"), layers, 40)
    assert sorted((r.a, r.b) for r in tiled.collect()) == want and "hashpartitioning" not in tiled._jdf.queryExecution().toString()
    assert P.extract_tiled(points.limit(0), layers, 40).collect() == [] and P.extract(points.limit(0), stored, ["a"], 40).collect() == []


def test_features_among_crowded_areas_leave_after_their_first_meeting(spark, monkeypatch):
    a, b = shapes(3, 40, 400), shapes(4, 700, 180)
    left = []
    put = GEO.written
    monkeypatch.setattr(GEO, "written", lambda df: left.append((out := put(df)).count()) or out)
    got = sorted(r.feature_id for r in GEO.meeting(polygons(spark, a), polygons(spark, b), 16.0).collect())
    want = [i for i, f in enumerate(a) if any(meet(f, g) for g in b)]
    assert got == want and 5 < len(got) < 40
    assert len(left) > 3 and left[-1] == 40 - len(want) and left[1] < 40 - len(want) / 2  # most are settled by the first few areas


def test_points_see_only_polygons_that_span_their_place(spark):
    box = lambda x, y, w: [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]
    small = [box(40 * i, 3, 9) for i in range(100)]  # all in one band of y
    areas = polygons(spark, [*small, box(-5000, -5000, 10000)])
    points = spark.createDataFrame([(i, 40.0 * i + (4 if i % 2 else 20), 5.0) for i in range(100)], "_p long, x double, y double")
    assert GEO._beside(points, areas, 16.0).count() < 100 * 8  # each with each would be 20,000
    got = {(r._p, r._q) for r in GEO._contained(points, areas, 16.0).collect()}
    assert got == {(i, 100) for i in range(100)} | {(i, i) for i in range(1, 100, 2)}


def test_a_holed_feature_inside_an_area_meets_it(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    holed = polygons(spark, [[square(10, 20), square(12, 18)], [square(10, 20), square(10, 12)], [square(200, 210)]])
    assert {r.feature_id for r in GEO.meeting(holed, polygons(spark, [[square(0, 100)]]), 5.0).collect()} == {0, 1}


def test_slanted_features_that_only_edges_settle(spark, monkeypatch):
    """No corner lies in an area: the edges alone decide, and features that have crossed one leave."""
    rnd = np.random.default_rng(5)
    a = [[[(0, 10 * i), (300, 10 * i + 90), (1, 10 * i + 2)]] for i in range(60)]  # thin, across many squares
    at = [(x, y) for x, y in zip(rnd.random(600) * 200 + 50, rnd.random(600) * 300 + 20, strict=True)]
    b = [[[(x, y), (x + 2, y), (x + 2, y + 2), (x, y + 2)]] for x, y in at]
    left = []
    put = GEO.written
    monkeypatch.setattr(GEO, "written", lambda df: left.append((out := put(df)).count()) or out)
    monkeypatch.setattr(GEO, "USUAL_EDGES", 4)
    got = sorted(r.feature_id for r in GEO.meeting(polygons(spark, a), polygons(spark, b), 16.0).collect())
    want = [i for i, f in enumerate(a) if any(meet(f, g) for g in b)]
    assert got == want and 5 < len(got) < 60
    assert left[0] == 60 and left[1] < 60 and left[-1] == 60 - len(want)


@pytest.mark.parametrize("usual", [1, 10**6])
def test_equal_shapes_are_compared_once(spark, monkeypatch, usual):
    a, b = shapes(6, 12, 300), shapes(7, 8, 300)
    compared = []
    crossing = GEO._crossing
    monkeypatch.setattr(GEO, "_crossing", lambda f, g, step: compared.append((f.count(), g.count())) or crossing(f, g, step))
    monkeypatch.setattr(GEO, "USUAL_EDGES", usual)
    none = spark.createDataFrame([(1000, None)], "feature_id long, rings array<array<array<double>>>")
    got = sorted(r.feature_id for r in GEO.meeting(polygons(spark, a * 30).union(none), polygons(spark, b * 30), 16.0).collect())
    met = [any(meet(f, g) for g in b) for f in a]
    assert got == [i for i in range(360) if met[i % 12]] and 1 < sum(met) < 12
    assert max(f for f, _ in compared) <= 13 and max(g for _, g in compared) <= 8
