"""Scene search against a loop over all pairs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import composite, search
from tessera.plans import observing

SCENES = "scene_id long, collection string, west double, south double, east double, north double, ts timestamp, cloud_cover double"
SEARCHES = "search_id long, collection string, west double, south double, east double, north double, start timestamp, end timestamp, max_cloud double"


def plain(scenes, searches):
    out = []
    for s in searches:
        for c in scenes:
            if s[1] is None or s[1] != c[1] or any(v is None for v in (*s[2:6], *c[2:6])) or c[2] > c[4] or c[3] > c[5]:
                continue
            lon = c[4] >= s[2] or c[2] <= s[4] if s[2] > s[4] else c[2] <= s[4] and s[2] <= c[4]
            time = (s[6] is None or c[6] is not None and c[6] >= s[6]) and (s[7] is None or c[6] is not None and c[6] <= s[7])
            if lon and c[3] <= s[5] and s[3] <= c[5] and time:
                out.append((s[0], c[0], s[8] is None or (c[7] or 0.0) <= s[8]))
    return sorted(out)


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    day = lambda n: dt.datetime(2019, 11, 5) + dt.timedelta(days=int(n))
    maybe = lambda v, p: None if rng.random() < p else v
    scenes, searches = [], []
    for k in range(500):
        w, s = rng.uniform(-180, 178), rng.uniform(-88, 86)
        scenes.append((k, str(rng.choice(["a", "b"])), maybe(w, 0.02), s, min(w + float(rng.choice([0, 1, 5])), 180.0), s + 2.0, maybe(day(rng.integers(0, 2000)), 0.1), maybe(float(rng.integers(0, 100)), 0.2)))
    for k in range(120):
        w, s, side = rng.uniform(-180, 180), rng.uniform(-90, 90), float(rng.choice([0, 0.3, 7, 40, 200]))
        start = int(rng.integers(0, 2000))
        searches.append((k, maybe(str(rng.choice(["a", "b", "c"])), 0.03), w, s, ((w + side + 180) % 360 - 180) if side < 200 else w, s + side, maybe(day(start), 0.3), maybe(day(start + int(rng.choice([0, 20, 200, 5000]))), 0.3), maybe(float(rng.integers(0, 100)), 0.3)))
    searches += [(900, "a", -180.0, -90.0, 180.0, 90.0, None, None, None), (901, "a", 10.0, 5.0, 20.0, 0.0, None, None, None), (902, "b", None, 0.0, 1.0, 1.0, None, None, None), (903, "a", -180.0, -90.0, 180.0, 90.0, day(0), None, 50.0), (904, "b", 170.0, -90.0, 169.0, 90.0, None, day(900), None), (905, "b", -180.0, -90.0, 180.0, 90.0, day(900), day(100), None)]
    asked = spark.createDataFrame(searches, SEARCHES)
    found = search.matches(spark.createDataFrame(scenes, SCENES), asked)
    want = plain(scenes, searches)
    assert sorted((r.search_id, r.scene_id, r.kept) for r in found.collect()) == want and len(want) > 500
    n = {r.search_id: (r.n_found, r.n_kept) for r in search.counts(asked, found).collect()}
    assert n == {s[0]: (sum(w[0] == s[0] for w in want), sum(w[0] == s[0] and w[2] for w in want)) for s in searches}
    assert search.matches(spark.createDataFrame([], SCENES), asked).count() == 0
    assert search.matches(spark.createDataFrame(scenes, SCENES), asked.limit(0)).count() == 0


@pytest.fixture(scope="module")
def crowded():
    """Thousands of scenes in one square, found by most searches; some searches go over the date line."""
    rng = np.random.default_rng(5)
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=int(n))
    scenes = [(k, "a", w, s, w + 1.5, s + 1.0, None if k % 31 == 0 else day(rng.integers(0, 90)), None if k % 7 == 0 else float(rng.integers(0, 100))) for k, (w, s) in enumerate(zip(rng.uniform(2, 13, 2500).tolist(), rng.uniform(1, 18, 2500).tolist(), strict=True))]
    scenes += [(9000 + k, "a", w, 3.0, w + 2.0, 4.0, day(k), 50.0) for k, w in enumerate([-180.0, -179.5, 175.0, 178.0, 178.5, 10.0])]
    searches = [(k, "a", 3.0 + k % 5, 2.0 + k % 3, 9.0 + k % 9, 7.0 + k % 12, None if k % 4 == 0 else day(k), None if k % 3 == 0 else day(k + 20), None if k % 5 == 0 else float(k)) for k in range(60)]
    searches += [(100, "a", 176.0, 0.0, 5.0, 20.0, None, None, 40.0), (101, "a", 176.0, 0.0, 175.0, 20.0, day(2), None, None), (100, "a", 5.0, 5.0, 5.0, 5.0, None, None, None)]
    return scenes, searches


def test_tallies_equal_all_pairs_in_parts(spark, crowded, monkeypatch):
    """A square of several words of bits, dealt out over several parts; a search's id stands twice."""
    monkeypatch.setattr(search, "PART", 700)
    scenes, searches = crowded
    want = plain(scenes, searches)
    there, asked = spark.createDataFrame(scenes, SCENES), spark.createDataFrame(searches, SEARCHES)
    assert sorted((r.search_id, r.scene_id, r.kept) for r in search.matches(there, asked).collect()) == want and len(want) > 20_000
    got = [(r.search_id, r.n_found, r.n_kept) for r in search.tallies(there, asked).collect()]
    assert sorted(got) == sorted((s[0], sum(w[0] == s[0] for w in want), sum(w[0] == s[0] and w[2] for w in want)) for s in searches)
    empty = spark.createDataFrame([], SCENES)
    assert {(r.n_found, r.n_kept) for r in search.tallies(empty, asked).collect()} == {(0, 0)} and search.tallies(there, asked.limit(0)).count() == 0


def test_no_side_is_copied_for_a_join_of_pairs(spark, crowded):
    """Pairs come from sets of bits: nothing is broadcast or dealt once more for them."""
    found = search.matches(*(spark.createDataFrame(x, y) for x, y in zip(crowded, (SCENES, SEARCHES), strict=True)))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_counts_are_not_made_from_pairs(spark, monkeypatch):
    from tessera.plans import catalogue

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, search.counts(*(lambda a: (a, search.matches(observing.boxed_scenes(spark, sf), a)))(observing.searches(spark, sf))).collect()))
    monkeypatch.setattr(search, "matches", None)
    assert sorted(map(tuple, catalogue.queries()["search_counts"](spark, sf).collect())) == want


def test_no_cross_join(spark):
    df = search.matches(spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 1.0, dt.datetime(2020, 1, 1), None)], SCENES), spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 1.0, None, None, None)], SEARCHES))
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and df.count() == 1


def test_intervals(spark):
    t = spark.createDataFrame([("2024-04-01/2024-06-30",), ("2024-04-01/..",), ("../2024-06-30T12:00:00",), ("2024-04-01",), ("/2024-04-01",), (None,)], "t string")
    start, end = search.parse_interval(F.col("t"))
    got = [tuple(None if v is None else v.isoformat() for v in r) for r in t.select(start.alias("a"), end.alias("b")).collect()]
    last = "T23:59:59.999999"
    assert got == [("2024-04-01T00:00:00", "2024-06-30" + last), ("2024-04-01T00:00:00", None), (None, "2024-06-30T12:00:00"), ("2024-04-01T00:00:00", "2024-04-01" + last), (None, "2024-04-01" + last), (None, None)]


def test_too_many_windows_are_refused(spark):
    cells = spark.createDataFrame([("t", 0, 0)], "tile_id string, row long, col long")
    with pytest.raises(ValueError, match="no seasons"):
        composite.on_skeleton(cells, spark.range(10_001).select(F.col("id").cast("string").alias("window")), cells.withColumn("window", F.lit("x")), ["tile_id", "window", "row", "col"])
