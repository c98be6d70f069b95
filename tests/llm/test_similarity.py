"""SimHash, embeddings and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from tessera.llm import hnsw, simhash
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    near = docs[0][1].split(" ")
    docs += [(900, None), (901, ""), (902, " \n"), (903, "ONE two"), (904, "one Two"), (905, docs[1][1]), (906, "É x É x")] + [(910 + k, " ".join(near[:k] + ["extra"] + near[k:])) for k in range(5, 300, 37)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    fps = {i: fingerprint(t) for i, t in docs}
    assert {i: f"{fp:016x}" for i, fp in fps.items()} == {i: g[0] for i, g in got.items()}
    ids = sorted(fps)
    want = classes(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert want == {i: g[1] for i, g in got.items()}


def test_anchors_and_texts_are_not_broadcast(spark):
    """A fingerprint of 8 bytes becomes 34 rows, and files of copies are small: neither goes through the driver."""
    fps = spark.createDataFrame([(k * 0x9E3779B97F4A7C15 % (1 << 63),) for k in range(50)], "fp long")
    docs = spark.createDataFrame([(k, f"text number {k % 7}") for k in range(50)], "doc_id long, text string")
    linked, found = simhash.links(fps), simhash.near_duplicates(docs)
    linked.collect()  # adaptive execution plans anew from the sizes of what was shuffled
    for plan in (linked._jdf.queryExecution().executedPlan(), linked._jdf.queryExecution().sparkPlan(), found._jdf.queryExecution().sparkPlan()):
        assert "Broadcast" not in plan.toString()


def test_one_of_each_group_stays(spark):
    text = "some words of a text that stands here more than once and is long enough"
    df = spark.createDataFrame([(5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (9, "quite another text with other words in it", "d")], "doc_id long, text string, fp string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns and sorted(r.fp for r in out.collect()) == ["b", "b", "c", "d"]


def test_one_of_each_group_stays_whatever_the_columns_are_called(spark):
    text = "some words of a text that stands here more than once and is long enough"
    df = spark.createDataFrame([("b", text, True, 1), ("a", text, None, 2), ("c", None, False, 3), ("d", "", False, 4)], "id string, text string, `_kept` boolean, kept int")
    out = simhash.keep_one(df, id_col="id")
    assert out.columns == df.columns and sorted(r.id for r in out.collect()) == ["a", "c"]
    assert simhash.keep_one(df.limit(0), id_col="id").count() == 0 and simhash.near_duplicates(df.limit(0), id_col="id").count() == 0


def test_anchors_meet_for_every_close_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64) ^ np.left_shift(rng.integers(0, 2, 60), 63)
    close = [int(x) ^ int(sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 4), replace=False))) for x in base]
    pairs = [(int(a), b) for a, b in zip(base, close, strict=True)]
    rows = simhash.anchors(spark.createDataFrame([(x,) for p in pairs for x in p], "fp long")).collect()
    home, came = {}, {}
    for r in rows:
        came.setdefault(r.fp, set()).add((r.half, r.anchor))
        if r.home:
            home.setdefault(r.fp, set()).add((r.half, r.anchor))
    assert all(len(h) == 2 for h in home.values()) and max(len(c) for c in came.values()) <= 34
    assert all(home[a] & came[b] for a, b in pairs)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[129] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 16))
    v[50:120] = v[0] + rng.normal(size=(70, 16)) * 0.05
    v[200:210] = v[5]
    rows = [(i, [float(x) for x in v[i].astype(np.float32)], int(i % 3)) for i in range(300)]
    odd = [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [1.0, None] * 8, 1), (404, [float(x) for x in v[0].astype(np.float32)], None), (405, [float("inf")] * 16, 1), (406, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df).collect()}
    f = np.array([r[1] for r in rows])
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.arange(300)[:, None] % 3 == np.arange(300) % 3) & ~np.eye(300, dtype=bool)
    want = classes(range(300), np.argwhere(near).tolist())
    assert {i: got[i][0] for i in range(300)} == dict(enumerate(near.sum(axis=1).tolist()))
    assert {i: got[i][1] for i in range(300)} == want
    assert all(got[i] == (0, i, True) for i, *_ in odd)


@pytest.mark.parametrize("n", [1, 2, 900])
def test_graph_recall(n):
    v = hnsw.units(np.random.default_rng(1).normal(size=(n, 12)))
    g = hnsw.Graph(v)
    found = g.find(v[:200], min(24, n))
    truth = np.argsort(-(v[:200] @ v.T), axis=1)[:, : min(5, n)]
    assert np.mean([len(np.intersect1d(a, b)) / len(b) for a, b in zip(found, truth, strict=True)]) >= 0.9
