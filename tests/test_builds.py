"""The catalogue of builds: all of a run or nothing of it."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import builds


def tables(spark, ids, found, more=()):
    b = spark.createDataFrame([(i, f"2024-0{i}-01") for i in ids], "build_id int, built_at string")
    s = spark.createDataFrame([(i, "a", "w", found, found - 1) for i in ids], "build_id int, collection string, window string, found int, kept int")
    v = spark.createDataFrame([(i, n, 0.5) for i in ids for n in ("x", "y")], "build_id int, variable string, valid double")
    for name in more:
        s = s.withColumn(name, F.lit("new"))
    return b, s, v


def seen(spark, root):
    return [sorted(map(tuple, builds.read(spark, root, t).select("build_id", *c).collect())) for t, c in (("builds", ["built_at"]), ("build_sources", ["found"]), ("build_variables", ["variable"]))]


def test_runs_replace_builds_whole(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    builds.record(root, *tables(spark, [1, 2], 10))
    first = seen(spark, root)
    assert first[1] == [(1, 10), (2, 10)] and len(first[2]) == 4
    builds.record(root, *tables(spark, [2, 3], 20, ["version"]))
    assert seen(spark, root)[1] == [(1, 10), (2, 20), (3, 20)]
    versions = {r.build_id: r.version for r in builds.read(spark, root, "build_sources").collect()}
    assert versions == {1: None, 2: "new", 3: "new"}
    assert {(r.build_id, r.found) for r in builds.latest(spark, root).collect()} == {(3, 20)}
    builds.record(root, *tables(spark, [3], 30))
    assert seen(spark, root)[1] == [(1, 10), (2, 20), (3, 30)] and len(seen(spark, root)[0]) == 3


@pytest.mark.parametrize("broken", [1, 2])
def test_a_run_that_fails_between_two_writes_leaves_the_old_build(spark, tmp_path, broken):
    root = str(tmp_path / "catalogue")
    builds.record(root, *tables(spark, [1, 2], 10))
    before = seen(spark, root)
    new = list(tables(spark, [2, 3], 20))
    # fails when it is written, after the tables before it were
    new[broken] = new[broken].withColumn("fails", F.when(F.col("build_id") > 0, F.raise_error(F.lit("lost"))).otherwise(F.lit("")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        builds.record(root, *new)
    assert seen(spark, root) == before
    builds.record(root, *tables(spark, [2, 3], 20))
    assert seen(spark, root)[1] == [(1, 10), (2, 20), (3, 20)]


def test_refusals(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    b, s, v = tables(spark, [1], 10)
    with pytest.raises(ValueError, match="not recorded"):
        builds.record(root, b, s.withColumn("build_id", F.lit(9)), v)
    with pytest.raises(ValueError, match="listed twice"):
        builds.record(root, b.unionByName(b), s, v)
    with pytest.raises(ValueError, match="no table"):
        builds.read(spark, root, "others")
