import numpy as np

from pixelweave.plans import queries as Q

D = "/root/testdata/sf0.1"


def test_distances_and_regridding_of_the_whole_grid(spark):
    px = Q.pixels(spark, D).select("row", "col", "forest_t1").toPandas()
    got = Q.Q["dist_to_edge"](spark, D).toPandas().sort_values(["row", "col"])
    own = px[px["forest_t1"].notna()].sort_values(["row", "col"])
    assert len(got) == len(own) and got["row"].max() >= 100
    edge = px[px["forest_t1"] == 0][["row", "col"]].to_numpy()
    some = slice(None, None, 997)
    want = [30 * np.sqrt(((edge - at) ** 2).sum(axis=1).min()) for at in own[["row", "col"]].to_numpy()[some]]
    assert np.allclose(got["dist"].to_numpy()[some], want, atol=1e-5)
    for name in ("regrid_nearest", "regrid_bilinear"):
        assert Q.Q[name](spark, D).count() == len(px)
