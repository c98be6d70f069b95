"""Simulations of drawings by trained trees, against the whole grid rebuilt for one scenario at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import features, polygons, simulate
from tessera.plans import drawn
from tessera.plans import tables as T
from tessera.plans.acting import KEYS

SF = "/root/testdata/sf0.001"


def near(field):
    """5 x 5 mean with repeated edges that ignores missing values."""
    h, w = field.shape
    r, c = np.clip(np.arange(-2, h + 2), 0, h - 1), np.clip(np.arange(-2, w + 2), 0, w - 1)
    wide = field[np.ix_(r, c)]
    return np.array([[np.nanmean(wide[i : i + 5, j : j + 5]) if np.isfinite(wide[i : i + 5, j : j + 5]).any() else np.nan for j in range(w)] for i in range(h)])


def dilated(mask):
    out = mask.copy()
    for _ in range(2):
        p = np.pad(out, 1)
        out = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return out


@pytest.fixture(scope="module")
def made(spark):
    table = drawn.simulated_table(spark, SF)
    model = features.train(features.training_frame(table), rounds=3, depth=4)
    grid = drawn._grid(spark, SF)
    requests = drawn.drawn_requests(spark, SF)
    out = simulate.run(requests, grid, table, simulate.by_trees(model), KEYS)
    return table, model, grid, requests, {r.scenario_id: r for r in out.collect()}


def test_equals_one_scenario_at_a_time(spark, made):
    table, model, grid, requests, got = made
    rows = table.toPandas()
    at = (rows["row"].to_numpy(int), rows["col"].to_numpy(int))
    blank = lambda: np.full((grid.height, grid.width), np.nan)
    layers = {}
    for name in (*features.BASE, "landcover", "population", *features.WEATHER):
        layers[name] = blank()
        layers[name][at] = rows[name].astype(float)
    exists = np.isfinite(layers["landcover"])

    def predicted(fields):
        fields = fields | {f"{n}_near": near(fields[n]) for n in features.NEAR}
        frame = spark.createDataFrame([(int(i), int(j), int(layers["landcover"][i, j]), *(float(fields[n][i, j]) for n in features.NUMERIC)) for i, j in zip(*np.nonzero(exists))], "row int, col int, landcover int, " + ", ".join(f"{n} double" for n in features.NUMERIC))
        out = blank()
        for r in model.transform(frame).select("row", "col", "predicted").collect():
            out[r.row, r.col] = r.predicted
        return out

    before = predicted(layers)
    tree = {v: np.median(layers[v][layers["landcover"] == 10]) for v in ("ndvi", "ndbi", "albedo")}
    asked = {r.scenario_id: r for r in requests.collect()}
    _, runs = polygons.masks(requests, ["scenario_id"], grid)
    masks = {}
    for r in polygons.cells_of(runs, ["scenario_id"]).collect():
        masks.setdefault(r.scenario_id, np.zeros(before.shape, bool))[r.row, r.col] = True
    fine = sorted(k for k, r in got.items() if r.status == "ok")
    assert fine and set(fine) <= set(masks)
    for k in fine[:: max(1, len(fine) // 6)]:
        canopy = np.clip((layers["ndvi"] - 0.1) / max(tree["ndvi"] - 0.1, 1e-6), 0, 1)
        plantable = masks[k] & exists & ~np.isin(layers["landcover"], (80, 0))
        fraction = np.where(plantable, np.minimum(asked[k].canopy_fraction_added, 1 - canopy), 0)
        after = predicted(layers | {v: layers[v] + fraction * (tree[v] - layers[v]) for v in tree})
        delta, planted = after - before, fraction > 0
        ring = dilated(planted) & ~planted & np.isfinite(delta)
        r = got[k]
        mean = lambda m: delta[m & np.isfinite(delta)].mean() if (m & np.isfinite(delta)).any() else 0.0
        assert r.cells_changed == planted.sum() and r.ring_cells == ring.sum() and r.area_m2 == masks[k].sum() * 10_000
        assert r.mean_inside == pytest.approx(mean(planted), abs=1e-9) and r.mean_ring == pytest.approx(mean(ring), abs=1e-9)
        assert (r.min_delta, r.max_delta) == pytest.approx((np.nanmin(delta), np.nanmax(delta)), abs=1e-9)
        people = np.nan_to_num(np.maximum(layers["population"], 0))
        assert r.person_degrees == pytest.approx(np.nansum(-delta * people), abs=1e-6)
        assert r.mean_canopy_added == pytest.approx(fraction[planted].mean() if planted.any() else 0.0)


def test_refusals_and_air(spark, made):
    *_, got = made
    assert {r.status for r in got.values()} >= {"ok", "invalid", "not a polygon", "not one feature"}
    for r in got.values():
        if r.status != "ok":
            assert r.mean_inside is r.area_m2 is r.verdict is r.air_status is None
        else:
            assert r.air_status in ("no inventory", "not asked") and r.pm25_inside is None and r.impact is not None


def test_unknown_windows_and_tiles_without_trees(spark, made):
    table, model, grid, requests, _ = made
    bare = table.where("landcover <> 10")
    asked = requests.where("scenario_id < 40").withColumn("window", F.when(F.col("scenario_id") % 2 == 0, "1999-winter").otherwise(F.col("window")))
    out = {r.scenario_id: r.status for r in simulate.run(asked, grid, bare, simulate.by_trees(model), KEYS).collect()}
    seen = set(out.values())
    assert "ok" not in seen and seen & {"no tree cover to refer to", "no window 1999-winter"}


def test_the_change_is_predicted_without_an_exchange(spark, made):
    table, model, *_ = made
    rows = table.limit(3).withColumns({f"{c}_before": F.col(c) for c in ("ndvi", "ndbi", "albedo", "ndvi_near", "ndbi_near")})
    out = simulate.by_trees(model)(rows)
    assert all(r.p0 == r.p1 for r in out.collect()) and T.WIDTH == 50
