import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import distance as X


def table(spark, height, width, share, seed, missing=0.0, low=(0, 0)):
    rnd = np.random.default_rng(seed)
    there, hit = rnd.random((height, width)) >= missing, rnd.random((height, width)) < share
    rows = [(int(r) + low[0], int(c) + low[1], bool(hit[r, c]) if (r + c) % 11 else None) for r, c in zip(*np.nonzero(there), strict=True)]
    return rows, spark.createDataFrame(rows, "row int, col int, t boolean").repartition(3)


def brute(rows):
    targets = np.array([(r, c) for r, c, t in rows if t])
    places = np.array([(r, c) for r, c, _ in rows])
    return {(int(r), int(c)): np.sqrt(((targets - (r, c)) ** 2).sum(axis=1).min()) * 30 for r, c in places}


@pytest.mark.parametrize(
    ("height", "width", "share", "missing", "low"),
    [(40, 37, 0.02, 0.0, (0, 0)), (9, 90, 0.01, 0.3, (0, 0)), (90, 9, 0.01, 0.3, (5, 1003)), (50, 50, 0.0006, 0.5, (0, 0)), (33, 34, 0.5, 0.1, (2, 3)), (1, 60, 0.05, 0.0, (0, 0))],
)
def test_distances_equal_brute_force(spark, height, width, share, missing, low):
    rows, px = table(spark, height, width, share, 4, missing, low)
    if not any(t for *_, t in rows):
        rows[0] = (*rows[0][:2], True)
        px = spark.createDataFrame(rows, "row int, col int, t boolean")
    got = {(r.row, r.col): r.dist for r in X.distance_to(px, F.col("t"), 30.0, tile=8).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_only_the_asked_pixels_are_valued_and_none_without_a_target(spark):
    rows, px = table(spark, 20, 20, 0.05, 1)
    got = {(r.row, r.col): r.dist for r in X.distance_to(px, F.col("t"), 30.0, F.col("row") % 3 == 0, tile=6).collect()}
    want = {k: v for k, v in brute(rows).items() if k[0] % 3 == 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    none = X.distance_to(px, F.lit(False), 30.0, tile=6).collect()
    assert len(none) == 400 and all(r.dist is None for r in none)
    assert X.distance_to(px.limit(0), F.col("t"), 30.0).collect() == []


def test_a_target_of_a_tile_without_pixels_counts(spark):
    # Column 30 has its only pixel, a target, far below; the tile beside the asked pixel has no pixel at all.
    px = spark.createDataFrame([(0, 0, False), (40, 30, True), (41, 0, False)], "row int, col int, t boolean")
    got = {(r.row, r.col): r.dist for r in X.distance_to(px, F.col("t"), 1.0, tile=8).collect()}
    assert got == {(0, 0): 50.0, (40, 30): 0.0, (41, 0): (30**2 + 1) ** 0.5}


def test_a_tile_sends_few_places():
    # Gaps that fall towards the right edge are all lowest somewhere to the left, but each tile gets its own stretch only.
    gaps = (np.arange(64, 0, -1)[None, :] ** 2).repeat(3, axis=0)
    sent = X.reaching(gaps, 64, 1, 0, 5, 64)
    assert sum(len(v) for t, v in sent.items() if t > 1) == 3 * 4  # the last column for each tile on the right
    at = np.arange(6 * 64)
    for t, places in sent.items():
        for r in range(3):
            best = ((at[t * 64 : t * 64 + 64, None] - np.arange(64, 128)) ** 2 + gaps[r]).min(axis=1)
            x, h = zip(*[(c, s) for row, c, s in places if row == r], strict=True)
            assert np.array_equal(((at[t * 64 : t * 64 + 64, None] - np.array(x)) ** 2 + np.array(h)).min(axis=1), best)


def test_envelope_is_the_minimum():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        x = np.sort(rnd.choice(200, 30, replace=False))
        h, at = rnd.integers(0, 3000, 30), np.arange(200)
        hull, starts = X.envelope(x.tolist(), h.tolist())
        q = np.array(hull)[np.searchsorted(np.array(starts), at, side="right") - 1]
        assert np.array_equal((at - x[q]) ** 2 + h[q], ((at[:, None] - x) ** 2 + h).min(axis=1))
