"""Steps to a mask against all pairs of cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import raster


@pytest.mark.parametrize("reach", [0, 1, 3, 10, 100])
def test_distances_equal_all_pairs(spark, reach):
    rng = np.random.default_rng(reach)
    masks = {"one": [(5, 7)], "corner": [(0, 0), (17, 22)], "many": [(int(r), int(c)) for r, c in zip(rng.integers(0, 18, 40), rng.integers(0, 23, 40))], "line": [(r, 3) for r in range(18)], "twice": [(4, 4), (4, 4), (4, 9), (12, 4)]}
    df = spark.createDataFrame([(k, r, c) for k, cells in masks.items() for r, c in cells], "k string, row long, col long")
    got = {}
    for r in raster.distances(df, ["k"], reach, 18, 23).collect():
        assert (r.row, r.col) not in got.setdefault(r.k, {})
        got[r.k][r.row, r.col] = r.distance
    for k, cells in masks.items():
        every = {(r, c): min(abs(r - a) + abs(c - b) for a, b in cells) for r in range(18) for c in range(23)}
        assert got[k] == {p: d for p, d in every.items() if d <= reach}


def test_rings_equal_dilation(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("a", int(r), int(c)) for r, c in zip(rng.integers(0, 30, 25), rng.integers(0, 30, 25))], "k string, row long, col long").distinct()
    d = raster.distances(df, ["k"], 3, 30, 30)
    for steps in (1, 2, 3):
        ring = {(r.row, r.col) for r in d.where(F.col("distance").between(1, steps)).collect()}
        assert ring == {(r.row, r.col) for r in raster.dilation_ring(df, ["k"], steps, 30, 30).collect()}
    assert raster.distances(df.limit(0), ["k"], 3, 30, 30).count() == 0
