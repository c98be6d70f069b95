"""Links of embeddings where the graph's search misses nodes."""

import numpy as np
import pytest

from tessera.llm import hnsw


class Blind:
    """A graph whose search never comes near its query."""

    def __init__(self, exact):
        self.exact = exact

    def find(self, queries, beam):
        return np.argsort(queries @ self.exact.T, axis=1)[:, :beam]


def test_audit_without_true_pairs_still_judges():
    rng = np.random.default_rng(4)
    exact = hnsw.units(rng.normal(size=(400, 16)))
    queries = hnsw.units(rng.normal(size=(400, 16)))
    queries[7] = exact[31]
    audit = np.arange(400) % 50 == 0
    found, wanted, got = hnsw.matches(Blind(exact), exact, queries, audit, 0.98)
    assert wanted == got == 0
    assert [f.tolist() for f in found] == [[31] if i == 7 else [] for i in range(400)]


def test_own_node_is_no_match():
    exact = hnsw.units(np.random.default_rng(5).normal(size=(400, 16)))
    exact[9] = exact[8]
    found, _, _ = hnsw.matches(hnsw.Graph(exact), exact, exact, hnsw.audited(400), 0.98, np.arange(400))
    assert [f.tolist() for f in found] == [{8: [9], 9: [8]}.get(i, []) for i in range(400)]


def test_many_small_shards_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(700, 16))
    v[100:160] = v[0] + rng.normal(size=(60, 16)) * 0.05
    v[200:400:2] = v[201:401:2] + rng.normal(size=(100, 16)) * 0.02
    v[500:540] = v[5]
    v = v.astype(np.float32).astype(float)
    rows = [(2 * i + 1, v[i].tolist(), 1) for i in range(700)]
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard=120).collect()}
    u = hnsw.units(v)
    near = (u @ u.T >= 0.98) & ~np.eye(700, dtype=bool)
    assert [got[2 * i + 1] for i in range(700)] == near.sum(axis=1).tolist()


def test_shards_of_thousands_are_searched_by_their_graphs(spark):
    """Two shards of 3,000 nodes: beams answer, few queries need the whole shard."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(6000, 24))
    v[3000:] = v[:3000] + rng.normal(size=(3000, 24)) * 0.03
    v = v.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v[i].tolist(), "one") for i in range(6000)], "vec_id long, embedding array<float>, label string")
    _, nodes = hnsw.marked_vectors(df)
    told = hnsw.search(nodes, shard=3000).cache()
    said = hnsw.audited_recall(told).first()
    assert said.wanted > 50 and said.recall >= 0.9
    u = hnsw.units(v)
    want = int((u @ u.T >= 0.98).sum()) - 6000
    got = told.where("links IS NOT NULL").groupBy().sum("links").first()[0]
    assert 0.99 * want <= got <= want
    # a search by graphs alone, without the whole-shard comparison
    graph = hnsw.Graph(u[:3000])
    found = graph.find(u[3000:3400], hnsw.FIRST_BEAM)
    near = np.argmax(u[3000:3400] @ u[:3000].T, axis=1)
    assert np.mean([k in f for k, f in zip(near, found, strict=True)]) >= 0.9


def test_ids_and_numbers_at_the_limits(spark):
    one = [3e200, -2e200, 1e199]
    rows = [(None, [1.0, 2.0, 3.0], 1, "a"), (None, [1.0, 2.0, 3.0], 1, "b"), (7, one, 1, "c"), (5, [x * 1.001 for x in one], 1, "d"), (9, [3e-300, -2e-300, 1e-301], 1, "e"), (5, [0.0, 1.0, 0.0], 2, "f"), (8, [-0.0, 1.0, 0.0], 2, "g"), (6, [1.0, 2.0], 1, "h"), (None, None, 1, "i")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = sorted(map(tuple, hnsw.near_duplicates(df).collect()), key=str)
    want = [(None, 1, None, True)] * 2 + [(None, 0, None, True), (7, 2, 5, False), (5, 2, 5, True), (9, 2, 5, False), (5, 1, 5, True), (8, 1, 5, False), (6, 0, 6, True)]
    assert got == sorted(want, key=str)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        hnsw.near_duplicates(df.withColumn("vec_id", df.node))
