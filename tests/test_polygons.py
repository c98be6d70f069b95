"""Drawn polygons: validity, runs of cells, and what they hold, against plain loops."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.operators import polygons


def poly(*rings):
    return {"type": "Polygon", "coordinates": [[list(p) for p in r] for r in rings]}


def multi(*parts):
    return {"type": "MultiPolygon", "coordinates": [[[list(p) for p in r] for r in rings] for rings in parts]}


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def feature(g):
    return {"type": "Feature", "properties": {}, "geometry": g}


def listed(*f):
    return {"type": "FeatureCollection", "features": list(f)}


def wrapped(g, depth):
    for _ in range(depth):
        g = feature(g)
    return g


CASES = [
    (poly(box(0, 0, 4, 4)), "ok"),
    (poly(box(0, 0, 4, 4)[:-1]), "ok"),  # not closed
    (poly([(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]), "invalid"),
    (poly([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]), "invalid"),  # touches its own edge
    (poly([(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4), (0, 0)]), "invalid"),  # meets itself at a position
    (poly([(0, 0), (4, 0), (2, 0), (2, 4), (0, 0)]), "invalid"),  # runs back along itself
    (poly([(0, 0), (4, 0), (8, 0), (0, 0)]), "invalid"),  # flat
    (poly(box(0, 0, 8, 8), box(2, 2, 4, 4)), "ok"),
    (poly(box(0, 0, 8, 8), box(2, 2, 9, 4)), "invalid"),
    (poly(box(0, 0, 8, 8), box(9, 2, 11, 4)), "invalid"),
    (poly(box(0, 0, 8, 8), box(1, 1, 5, 5), box(2, 2, 3, 3)), "invalid"),  # a hole in a hole
    (poly(box(0, 0, 8, 8), [(0, 4), (2, 3), (2, 5), (0, 4)]), "ok"),  # a hole that touches
    (poly(box(2, 2, 3, 3), box(0, 0, 8, 8)), "invalid"),  # shell inside its hole
    (poly(box(0, 0, 8, 8), box(0, 0, 4, 4)), "invalid"),  # runs along the shell
    (multi([box(0, 0, 2, 2)], [box(4, 0, 6, 2)]), "ok"),
    (multi([box(0, 0, 2, 2)], [box(2, 2, 4, 4)]), "ok"),  # parts that touch in a corner
    (multi([box(0, 0, 2, 2)], [box(2, 0, 4, 2)]), "invalid"),  # parts with an edge in common
    (multi([box(0, 0, 4, 4)], [box(3, 3, 6, 6)]), "invalid"),
    (multi([box(0, 0, 9, 9)], [box(3, 3, 6, 6)]), "invalid"),
    (multi([box(0, 0, 9, 9), box(2, 2, 7, 7)], [box(3, 3, 6, 6)]), "ok"),  # an island in a hole
    (wrapped(poly(box(0, 0, 4, 4)), 4), "ok"),
    (wrapped(poly(box(0, 0, 4, 4)), 5), "nested too deep"),
    (listed(feature(poly(box(0, 0, 4, 4)))), "ok"),
    (listed(feature(poly(box(0, 0, 4, 4))), feature(poly(box(0, 0, 4, 4)))), "not one feature"),
    (listed(), "not one feature"),
    ({"type": "Feature", "properties": {}, "geometry": None}, "no geometry"),
    ({"type": "Point", "coordinates": [1, 2]}, "not a polygon"),
    ({"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "not a polygon"),
    (poly(), "no vertices"),
    (poly([(0, 0), (1, 1)]), "unreadable"),
    ({"type": "Polygon", "coordinates": [[[0, 0], [1, None], [1, 1], [0, 0]]]}, "unreadable"),
    (poly([(math.cos(k / 11000 * 6.28), math.sin(k / 11000 * 6.28)) for k in range(11000)]), "too many vertices"),
    (poly([(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4), (0, 0)]), "ok"),  # repeated positions
]


def test_statuses(spark):
    rows = [(k, json.dumps(g)) for k, (g, _) in enumerate(CASES)] + [(900, None), (901, ""), (902, "no json"), (903, "[1]"), (904, '{"type":"Polygon"}')]
    got = {r.id: r.status for r in polygons.checked(spark.createDataFrame(rows, "id long, geojson string"), ["id"]).collect()}
    assert {k: got[k] for k in range(len(CASES))} == {k: want for k, (_, want) in enumerate(CASES)}
    assert all(got[k] == "not a polygon" for k in range(900, 905))
    empty = spark.createDataFrame([], "id long, geojson string")
    assert polygons.checked(empty, ["id"]).count() == 0


def crosses(points):
    n = len(points)
    turn = lambda o, a, b: np.sign((a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0]))
    for i in range(n):
        for j in range(i + 2, n):
            if i == 0 and j == n - 1:
                continue
            a, b, c, d = points[i], points[(i + 1) % n], points[j], points[(j + 1) % n]
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                return True
    return False


def test_crossings_are_found_in_any_bucket(spark):
    """Stars with and without one crossing, of 5 to 400 corners, some very flat."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(60):
        n = int(rng.integers(5, 400 if k < 6 else 40))
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        radius = rng.uniform(0.2, 1, n)
        pts = np.c_[np.cos(angle) * radius * (1 if k % 3 else 1000), np.sin(angle) * radius]
        if k % 2:
            i = int(rng.integers(0, n - 2))
            pts[[i, i + 1]] = pts[[i + 1, i]]
        rows.append((k, json.dumps(poly(pts.tolist()))))
        want[k] = crosses(pts.tolist())
    got = {r.id: r.status == "invalid" for r in polygons.checked(spark.createDataFrame(rows, "id long, geojson string"), ["id"]).collect()}
    assert got == want and 0 < sum(want.values()) < 60


def inside(x, y, rings):
    odd = False
    for r in rings:
        for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1]):
            if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
    return odd


def test_masks_and_measures_equal_loops(spark):
    grid = G.Grid(429000.0, 3497500.0, 100.0, 30, 40, 43)
    rng = np.random.default_rng(5)
    lonlat = lambda dx, dy: (74.27 + dx * 0.002, 31.595 + dy * 0.002)
    shapes = [[[(-2, 0), (0, 2), (2, 0), (0, -2)]], [[(-5, -4), (5, -4), (5, 4), (-5, 4)], [(-1, -1), (1, -1), (1, 1), (-1, 1)]], [[(-9, -9), (9, -8), (0, 1), (8, 9), (-9, 9)]], [[(90, 90), (91, 90), (91, 91)]]]
    rows = [(k, json.dumps(poly(*[[lonlat(*p) for p in r] for r in rings]))) for k, rings in enumerate(shapes)]
    status, runs = polygons.masks(spark.createDataFrame(rows, "id long, geojson string"), ["id"], grid)
    want = {}
    for k, rings in enumerate(shapes):
        metres = [[G._project(*lonlat(*p), 43) for p in r] for r in rings]
        want[k] = {(r, c) for r in range(30) for c in range(40) if inside(429000 + (c + 0.5) * 100, 3497500 - (r + 0.5) * 100, metres)}
    got = {}
    for r in polygons.cells_of(runs, ["id"]).collect():
        got.setdefault(r.id, set()).add((r.row, r.col))
    assert got == {k: v for k, v in want.items() if v} and not want[3]
    assert {r.id: r.status for r in status.collect()} == {0: "ok", 1: "ok", 2: "ok", 3: "no cells"}
    # a table with missing cells and missing values, of two tiles
    cells = [(t, r, c, None if rng.random() < 0.1 else float(rng.random())) for t in "ab" for r in range(30) for c in range(40) if rng.random() < 0.8]
    table = spark.createDataFrame(cells, "tile_id string, row long, col long, headroom double")
    out = polygons.measure(status, runs.withColumn("tile_id", F.when(F.col("id") == 1, "b").otherwise("a")), table, ["id"], ["tile_id"], 40, 10.0, spark.createDataFrame([("a", None), ("b", None)], "tile_id string, reason string"))
    for r in out.collect():
        held = [v for t, row, col, v in cells if t == ("b" if r.id == 1 else "a") and (row, col) in want[r.id]]
        if r.status == "ok":
            assert (r.cells, r.area_m2) == (len(held), len(held) * 10.0) and r.plantable_canopy_m2 == pytest.approx(sum(v or 0 for v in held) * 10)
        else:
            assert r.cells is r.area_m2 is r.plantable_canopy_m2 is None
    refused = polygons.measure(status, runs.withColumn("tile_id", F.lit("a")), table, ["id"], ["tile_id"], 40, 10.0, spark.createDataFrame([("a", "no tree cover to refer to")], "tile_id string, reason string"))
    assert {r.status for r in refused.collect()} == {"no cells", "no tree cover to refer to"}


def test_a_wide_polygon_sends_two_rows_for_each_row_of_cells(spark):
    runs = spark.createDataFrame([(1, r, 0, 9_999) for r in range(50)], "id long, row long, c0 long, c1 long").withColumn("tile_id", F.lit("a"))
    sums = spark.createDataFrame([("a", r, c, float(c + 1)) for r in range(50) for c in (-1, 9_999)], "tile_id string, row long, col long, n double")
    got = polygons.totals(runs, sums, ["id"], ["tile_id"], ["n"]).collect()
    assert [(r.id, r.n) for r in got] == [(1, 500_000.0)]
