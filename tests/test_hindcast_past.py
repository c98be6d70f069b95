"""Windows of a cell are gathered once for all configurations."""

import numpy as np

from tessera.operators import hindcast


def test_medians_of_the_windows_before(spark):
    rng = np.random.default_rng(5)
    rows = [(t, f"w{w}", r, 0, 10 * r, float(rng.normal()), float(rng.normal()) if rng.random() < 0.6 else None) for t in "ab" for w in range(7) for r in range(9) if rng.random() < 0.7]
    cells = spark.createDataFrame(rows, "tile_id string, window string, row long, col long, landcover int, ndvi double, lst_c double")
    before = {1: ["w0", "w1", "w2", "w3"], 2: ["w3", "w4", "w5"], 3: ["nowhere"]}
    configs = spark.createDataFrame([(1, before[1], "w4", 5), (2, before[2], "w6", 10), (3, before[3], "w6", 5), (4, ["w0"], "w9", 5)], "config_id long, before array<string>, scored string, bins int")
    out = hindcast.with_past(configs, cells, "tile_id", {"_v0": "ndvi", "_t0": "lst_c"})
    assert out.columns == ["config_id", "bins", "tile_id", "row", "col", "window", "landcover", "ndvi", "lst_c", "_v0", "_t0"]
    at = {(t, w, r): (v, x) for t, w, r, _, _, v, x in rows}

    def median(t, r, ws, k):
        had = [at[t, w, r][k] for w in ws if (t, w, r) in at and at[t, w, r][k] is not None]
        return float(np.median(had)) if had else None

    want = {(c, t, r): (w, 10 * r, *at[t, w, r], median(t, r, before[c], 0), median(t, r, before[c], 1)) for c, w in ((1, "w4"), (2, "w6"), (3, "w6")) for t in "ab" for r in range(9) if (t, w, r) in at}
    got = {(x.config_id, x.tile_id, x.row): (x.window, x.landcover, x.ndvi, x.lst_c, x._v0, x._t0) for x in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose([np.nan if v is None else v for v in got[k][2:]], [np.nan if v is None else v for v in want[k][2:]], equal_nan=True) and got[k][:2] == want[k][:2] for k in want)
    assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") <= 2  # the initial plan has one shuffle
