"""Steps whose work, memory and broadcasts follow the input at any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.grid import Grid
from tessera.operators import features, kernel, polygons, roads, rounds, search

LINES = "way_id long, nth int, x double, y double"


def test_samples_are_counted_not_made(spark):
    """A way of 5e11 metres has 1e10 samples."""
    far = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3e11, 4e11), (2, 0, 0.0, 0.0), (2, 1, 0.0, 120.0)], LINES)
    stretch = roads.stretches(far)
    got = {r.way_id: (r.n_samples, r.length) for r in roads.sampled(stretch).collect()}
    assert got == {1: (10**10, 5e11), 2: (2, 120.0)}


@pytest.mark.parametrize("spacing", [3.0, 50.0, 170.0])
def test_cells_of_stretches_equal_those_of_samples(spark, spacing):
    """Ways that leave the grid, go backwards, stand upright and run along its edges."""
    rng = np.random.default_rng(3)
    rows = [(w, n, float(x), float(y)) for w in range(60) for n, (x, y) in enumerate(rng.uniform(-300, 1300, (4, 2)))]
    rows += [(1000 + w, n, float(x), float(y)) for w in range(60) for n, (x, y) in enumerate(rng.integers(-3, 13, (3, 2)) * 100 + w % 2 * 50)]
    ways = spark.createDataFrame(rows, LINES)
    grid, stacks = Grid(0.0, 1000.0, 100.0, 10, 10), spark.createDataFrame([(5.0, 5.0), (1000.0, 1000.0), (-1.0, 5.0)], "x double, y double")
    want = {(r.row, r.col): r.emission for r in roads.emission_cells(roads.densify(ways, spacing=spacing).withColumn("per_m", F.lit(1.0)), stacks, grid).collect()}
    got = {(r.row, r.col): r.emission for r in roads.stretch_cells(roads.stretches(ways, spacing=spacing).withColumn("per_m", F.lit(1.0)), stacks, grid).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_cells_of_a_very_long_stretch(spark):
    """2e9 samples in a column: two for each of its 10 rows are inside."""
    way = roads.stretches(spark.createDataFrame([(1, 0, 50.0, 500.0), (1, 1, 50.0, 500.0 + 1e11)], LINES)).withColumn("per_m", F.lit(1.0))
    cells = roads.stretch_cells(way, spark.createDataFrame([], "x double, y double"), Grid(0.0, 1000.0, 100.0, 10, 1)).collect()
    assert sorted((r.row, r.col, r.emission) for r in cells) == [(k, 0, 100.0) for k in range(5)]


def test_exploded_edges_are_not_broadcast(spark):
    """Estimates of a table's size do not see the rows that a drawing explodes to."""
    table = spark.createDataFrame([(1, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]])], "id long, parts array<array<array<struct<x: double, y: double>>>>")
    e = polygons.edges(table, ["id"])
    runs = spark.createDataFrame([(1, 0, 0, 3, "t")], "id long, row long, c0 long, c1 long, tile_id string")
    sums = polygons.running_sums(spark.createDataFrame([("t", 0, 0, 1.0)], "tile_id string, row long, col long, v double"), ["tile_id"], ["v"], 5)
    for step in (polygons.crossing(e, ["id"]), polygons.misplaced(e, ["id"]), sums, polygons.totals(runs, sums, ["id"], ["tile_id"], ["v"])):
        assert "Broadcast" not in step._jdf.queryExecution().sparkPlan().toString()


def test_fits_read_few_partitions(spark):
    """A task of a fit has many rows, whatever the step before left."""
    with features.together(spark.range(100).repartition(50)) as (frame, submit):
        assert submit(lambda k: frame.where(F.col("id") % 2 == k).rdd.getNumPartitions(), [0, 1]) == [1, 1] and frame.count() == 100


def test_searches_ask_for_ranks(spark):
    """Regions that no search can be offered meet none."""
    searches = spark.createDataFrame([(s, "cooling", s) for s in range(3)], "search_id long, metric string, step long")
    regions = spark.createDataFrame([("cooling", f"r{k:03d}", k + 1) for k in range(200)], "metric string, region_id string, rank int")
    tried = spark.createDataFrame([(s, f"r{k:03d}") for s in range(3) for k in range(s)], "search_id long, region_id string")
    out = rounds.offered(searches, regions, tried, shown=5)
    assert sorted((r.search_id, r.region_id, r.nth) for r in out.collect()) == [(s, f"r{s + k:03d}", k + 1) for s in range(3) for k in range(5)]
    assert "rank" in str(out._jdf.queryExecution().analyzed()).split("Join Inner")[1].split("\n")[0]


def test_pairs_of_searches_over_the_date_line_are_not_shuffled(spark):
    """A scene that meets both sides of the line is found once, without looking for copies."""
    box = "west double, south double, east double, north double"
    scenes = spark.createDataFrame([(k, "c", w, 0.0, e, 1.0, None, 5.0) for k, (w, e) in enumerate([(-180.0, 180.0), (171.0, 172.0), (-172.0, -171.0), (0.0, 1.0), (-175.0, 175.0), (165.0, 170.0)])], f"scene_id long, collection string, {box}, ts timestamp, cloud_cover double")
    searches = spark.createDataFrame([(1, "c", 170.0, 0.0, -170.0, 1.0, None, None, None), (2, "c", -10.0, 0.0, 10.0, 1.0, None, None, None)], f"search_id long, collection string, {box}, start timestamp, end timestamp, max_cloud double")
    found = search.matches(scenes, searches)
    assert sorted((r.search_id, r.scene_id) for r in found.collect()) == [(1, 0), (1, 1), (1, 2), (1, 4), (1, 5), (2, 0), (2, 3), (2, 4)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan and "Union" not in plan


def test_few_sources_that_become_many_parts_are_dealt(spark, monkeypatch):
    """Tasks are as many as the parts of sums ask for; blocks are a few for each task."""
    monkeypatch.setattr(kernel, "PARTS_A_TASK", 500)
    monkeypatch.setattr(kernel, "BLOCKS_A_TASK", 2)
    sources = spark.createDataFrame([("t", s, 40 * s + r, r, 1.0 + r) for s in range(6) for r in range(3)], "tile_id string, scenario_id long, row long, col long, emission double").coalesce(1)
    weights = spark.createDataFrame([("t", a, b, 1.0 / (1 + a * a + b * b)) for a in range(-3, 4) for b in range(-3, 4)], "tile_id string, dr int, dc int, weight double")
    keys = ["tile_id", "scenario_id"]
    want = {}
    for s in range(6):
        for r in range(3):
            for a in range(-3, 4):
                for b in range(-3, 4):
                    at = (s, 40 * s + r + a, r + b)
                    if at[1] >= 0 and at[2] >= 0:
                        want[at] = want.get(at, 0.0) + (1.0 + r) / (1 + a * a + b * b) * 1e6
    for out, tasks in ((kernel.concentration(sources, weights, keys, 300, 50), 2), (kernel.concentration_blocks(sources, weights, keys, 300, 50, block=16), 4)):
        got = {(r.scenario_id, r.row, r.col): r.concentration for r in out.collect()}
        assert all(got[k] == pytest.approx(v) for k, v in want.items()) and sum(abs(v) for k, v in got.items() if k not in want) < 1e-6
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert f", {tasks}), REPARTITION_BY_NUM" in plan
