"""Suffix-array and substring dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import recompress, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    long = docs[3][1]
    odd = [(5000, "x" * 700), (5001, "ab" * 300), (5002, None), (5003, ""), (5004, long), (5004, long), (None, "q" * 250 + docs[5][1][:300]), (5005, "x " * 60), (5006, "a b " * 30), (5007, "z a b " + "a b " * 20), (-5, docs[9][1][:900])]
    rng = np.random.default_rng(0)
    return docs + odd + [(6000 + i, " ".join(rng.choice(list("abc"), rng.integers(0, 40)))) for i in range(60)]


def brute_bytes(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        edge = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[: len(t)] > 0
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()) if len(t) else 0, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_suffix_dedup_equals_brute_force(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    got = [tuple(r) for r in suffix.digest(df).collect()]
    want = [(i, *x) for (i, _), x in zip(documents, brute_bytes([(t or "").encode() for _, t in documents]), strict=True)]
    assert by_id(got) == by_id(want)


def test_suffix_dedup_keeps_columns_and_nulls(spark):
    rows = [(1, "x" * 300, "k1"), (2, "x" * 150 + "é" * 80, "k2"), (3, None, None)]
    out = {r.doc_id: r for r in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()}
    assert out[1].text == "" and out[1].key == "k1" and out[2].text == "x" * 150 + "é" * 80 and out[3].text is None
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.digest(empty).count() == 0 and suffix.dedup(empty).columns == ["doc_id", "text"]


@pytest.mark.parametrize("seed", range(4))
def test_column_wise_order_is_the_suffix_order(seed):
    rng = np.random.default_rng(seed)
    docs = [d for d in (rng.integers(97, 100, rng.integers(0, 50)).astype(np.uint8) for _ in range(10)) if len(d)]
    size = np.array([len(d) for d in docs])
    start, data = np.cumsum(size) - size, np.concatenate(docs)
    order = suffix.bwt_order(data, start, size)
    owner = lambda p: int(np.searchsorted(start, p, "right")) - 1
    got = [bytes(data[p : start[owner(p)] + size[owner(p)]]) for p in order[len(docs) :]]
    assert got == sorted(bytes(d[i:]) for d in docs for i in range(len(d)))


@pytest.mark.parametrize("block", range(10))
def test_repeated_windows_of_tiny_collections(block):
    """10,000 random collections of one to six strings, in the order they come."""
    rng = np.random.default_rng(block)
    for _ in range(1000):
        window = int(rng.integers(1, 6))
        docs = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 14)).astype(np.uint8) for _ in range(rng.integers(1, 7))]
        size = np.array([len(d) for d in docs])
        start = np.cumsum(size) - size
        seen = Counter(bytes(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
        want = np.concatenate([[i + window <= len(d) and seen[bytes(d[i : i + window])] > 1 for i in range(len(d))] for d in docs]).astype(bool)
        assert (suffix.repeated_windows(np.concatenate(docs), start, size, window) == want).all()


def test_strings_that_share_a_little_less_than_a_window_stay(spark):
    """190 bytes in common, both ends differ: nothing occurs twice, whatever the order of rows."""
    rng = np.random.default_rng(3)
    for k in range(4):
        core = bytes(rng.integers(97, 123, 190).astype(np.uint8)).decode()
        ends = [bytes(rng.integers(97, 123, 10).astype(np.uint8)).decode() for _ in range(3)]
        rows = [(i, e[:5] + core + e[5:]) for i, e in enumerate(ends)]
        for order in (rows, rows[::-1], rows[1:] + rows[:1]):
            assert all(r.n_removed == 0 for r in suffix.digest(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect())


def test_text_longer_than_a_segment(spark):
    rng = np.random.default_rng(4)
    long = rng.integers(97, 123, suffix.SEGMENT + 5000).astype(np.uint8)
    long[suffix.SEGMENT - 150 : suffix.SEGMENT + 150] = long[1000:1300]  # a repeat across the border
    rows = [(1, bytes(long).decode()), (2, bytes(long[suffix.SEGMENT + 1000 : suffix.SEGMENT + 1250]).decode())]
    got = {r.doc_id: r for r in suffix.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (len(long), 850, 3) and got[2].n_removed == 250


@pytest.mark.parametrize("operator", [suffix, recompress])
def test_columns_with_any_names(spark, operator):
    words = " ".join(f"w{k}" for k in range(80))
    rows = [(1, words, True, "r1", 5), (2, words + " end", None, None, None), (3, None, False, "r3", 7), (4, "", True, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_null` boolean, `row` string, `part` int")
    out = {r.doc_id: r for r in operator.dedup(df).collect()}
    assert operator.dedup(df).columns == df.columns
    assert [(out[k]["_null"], out[k]["row"], out[k]["part"]) for k in (1, 2, 3, 4)] == [r[2:] for r in rows]
    assert out[3].text is None and out[4].text == "" and out[2].text.strip() == "end"
    odd = df.select("doc_id", "text", "part").toDF("key", "payload", "a.b")
    assert operator.dedup(odd, "key", "payload").count() == 4 and operator.dedup(odd, "key", "payload").columns == odd.columns


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("a", "x" * 300), ("b", "x" * 300), (None, "y")], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in suffix.digest(df).collect()} == {"a": 300, "b": 300, None: 0}
    with pytest.raises(TypeError, match="whole numbers"):
        recompress.digest(df)


def test_hot_anchor_is_split_by_sub_ranges():
    """Sub-pieces of an anchor cover all its windows, and shared bytes give equal buckets."""
    rng = np.random.default_rng(5)
    line = rng.integers(97, 123, 230).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, 90).astype(np.uint8), line, rng.integers(97, 123, 60).astype(np.uint8)]) for _ in range(6)]
    raw, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    text, s, w, a, ah, ph, more = suffix.pieces_of(raw, offsets)
    assert int(w.sum()) == sum(len(t) - 199 for t in texts)
    spans = sum(np.maximum(np.minimum(a, suffix.SUB_RANGE * j + suffix.SUB_RANGE - 1) - np.maximum(a - w + 1, suffix.SUB_RANGE * j) + 1, 0) for j in range(-(-256 // suffix.SUB_RANGE)))
    assert (spans == w).all()


def test_substring_dedup_equals_brute_force(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    got = [tuple(r) for r in recompress.digest(df).collect()]
    n = recompress.WINDOW
    words = [WORD.findall(t or "") for _, t in documents]
    order = lambda i: float("inf") if i is None else i
    least = {}
    for (i, _), w in zip(documents, words, strict=True):
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            least[g] = min(least.get(g, float("inf")), order(i))
    want = []
    for (i, _), w in zip(documents, words, strict=True):
        gone = {x for k in range(len(w) - n + 1) if least[tuple(w[k : k + n])] < order(i) for x in range(k, k + n)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert by_id(got) == by_id(want)


def test_determined_symbols_are_the_same_in_any_context():
    rng = np.random.default_rng(1)
    for _ in range(50):
        core = rng.integers(0, 4, 13).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        names = set()
        for _ in range(4):
            left, right = (rng.integers(0, 4, rng.integers(0, 9)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
            whole = np.concatenate([left, core, right])
            names.add(int(recompress.window_names(whole, np.zeros(len(whole), int), np.array([len(left)]))[0]))
        assert len(names) == 1


def test_substring_dedup_of_nothing(spark):
    assert recompress.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_results_do_not_depend_on_partitions(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string").where("doc_id IS NOT NULL")
    for operator in (suffix, recompress):
        one, many = (by_id([tuple(r) for r in operator.digest(df.repartition(n)).collect()]) for n in (1, 7))
        assert one == many
