"""k-means by a tournament of bisectors against a plain one."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from tessera.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=16, rounds=3, dims=64):
    """{(vec_id, components): (cluster, distance)} and the centroids, by loops over all pairs."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middle = [v for _, v in order[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in middle]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [near(v)[0] for _, v in kept]
        for c in range(len(middle)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                middle[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((str(i), *near(v)) for i, v in kept), middle


def held(df):
    return sorted((str(r.vec_id), r.cluster, r.distance) for r in df.collect())


@pytest.mark.parametrize("k", [1, 2, 7])
def test_tournament_equals_all_distances(k):
    rng = np.random.default_rng(k)
    for spread in (2, 1000, 1 << 26):
        c, v = rng.integers(-spread, spread, (k, 5)), rng.integers(-spread, spread, (500, 5))
        c[-1] = c[0]  # two equal centroids: the smaller number wins
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (centroids.Bisectors.of(c).nearest(v) == d.argmin(1)).all()


def test_equals_plain_clustering(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 64)) * 0.2
    rows = [(i, (base[i % 20] + rng.normal(size=64) * 0.02).astype(np.float32).tolist(), i) for i in range(300)]
    rows += [(5, rows[5][1], 0), (5, rows[6][1], 0), (None, rows[7][1], 0), (900, None, 1), (901, [1.0] * 63, 1), (902, [None] + [1.0] * 63, 1), (903, [math.nan] + [1.0] * 63, None), (904, [-math.inf] * 64, 1), (905, [], 1), (906, [0.0] * 64, 1), (907, [0.0] * 64, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = centroids.cluster(df)
    want, middle = plain(rows)
    assert held(out) == want
    got = out.collect()
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    inertia = [sum(d for _, c, d in want if c == n) for n in range(16)]
    assert all(r.centroid_sha256 == told[r.cluster] and r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia) for r in got)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_few_none_and_odd_tables(spark):
    few = [(i, [float(i)] * 64, 0) for i in range(3)] * 2
    assert held(centroids.cluster(spark.createDataFrame(few, SCHEMA))) == plain(few)[0]
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None, 0), (2, [1.0], 0)], SCHEMA)).count() == 0
    named = spark.createDataFrame([("a", "b", 1, few[0][1], 2)], "`vec_id.x` string, cluster string, `distance.d` int, embedding array<double>, embedding_ int")
    assert held(centroids.cluster(named, id_col="vec_id.x")) == [("a", 0, 0)]
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster(spark.createDataFrame([(1, [3e6] * 64, 0)], SCHEMA))


def test_equals_its_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op12_centroid_clustering"])
    got = queries.op12_centroid_clustering(spark, path).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
