"""Resampling by bit planes against sums feature by feature."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import importance, queries
from tessera.llm.common import text_bytes

import pyarrow as pa

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(docs, target, percent=25):
    """Rows as the text has them: loops over documents and features."""
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for n, (i, x) in enumerate(docs):
        words, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    return sorted([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < 20], key=str)


def held(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_planes_equal_plain_sums(seed):
    rng = np.random.default_rng(seed)
    gains = rng.integers(-(2 ** (3 + 5 * seed)), 2 ** (3 + 5 * seed) + 1, 10000)
    planes = importance.gain_planes(gains)
    texts = 600
    text, bucket = rng.integers(0, texts, 9000), rng.integers(0, 10000, 9000)
    code = np.unique(text * 10000 + bucket)
    text, bucket = code // 10000, code % 10000
    count = np.minimum(rng.zipf(1.4, len(code)), 1 << 40)
    want = np.zeros(texts, np.int64)
    np.add.at(want, text, count * gains[bucket])
    assert (importance.summed(text, bucket, count, texts, planes) == want).all()
    edge = np.array([0, 1, -1, 2**13, -(2**13), 2**13 - 1, -(2**13) - 1] + [0] * 9993)
    assert [int(importance.summed(np.zeros(1, np.int64), np.array([b]), np.array([3]), 1, importance.gain_planes(edge))[0]) for b in range(7)] == (edge[:7] * 3).tolist()


def test_features_equal_the_expression():
    texts = ["", None, "a", "A-b é1 ..", "日本 x y", "\x00\x7f{|}", "Don't stop", "one", "W" * 3000 + " " + "v" * 70000, "É é \U0001f600 b"]
    text, bucket, words = importance.buckets(*text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        w, f = features(t)
        assert words[k] == len(w) and sorted(bucket[text == k].tolist()) == sorted(f)


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 50)
    rng = np.random.default_rng(1)
    for text in ["x" * 400, "x" * 120 + " y " + "é" * 90, " ".join(map(str, rng.integers(0, 40, 400))), " . " * 200, "a " + "." * 200 + " b", "." * 60 + "tail words here"]:
        _, bucket, count, words = importance.counted(*text_bytes(pa.array([text])))
        w, f = features(text)
        assert words.tolist() == [len(w)] and dict(zip(bucket.tolist(), count.tolist())) == dict(Counter(f))


def test_equals_plain_resampling(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    docs += [(900, None), (901, ""), (902, "..."), (903, target[0]), (903, target[0]), (None, target[1]), (None, target[1]), (905, " ".join(["word"] * 5000)), (906, docs[3][1]), (docs[4][0], docs[5][1])]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in docs], "doc_id long, text string, score int, `rank.x` string").repartition(6)
    goal = spark.createDataFrame([(t, 1) for t in [*target, None, ""]], "text string, doc_id int")
    for percent in (25, 100, 0):
        assert held(importance.ranked(df, goal, percent)) == plain(docs, target, percent)
    drawn = importance.resample(df, goal)
    assert drawn.columns == df.columns
    ranked = [r for r in plain(docs, target) if r[4] is not None]
    last = max(ranked, key=lambda r: r[4])
    ties = sum((r[3], r[0]) == (last[3], last[0]) for r in plain(docs, target)) - sum((r[3], r[0]) == (last[3], last[0]) for r in ranked)
    got = Counter(str(r.doc_id) for r in drawn.collect())
    assert sum(got.values()) == len(ranked) + ties and not Counter(str(r[0]) for r in ranked) - got


def test_empty_tables(spark):
    docs = spark.createDataFrame([(k, f"some words {k} " * 9) for k in range(8)], "doc_id long, text string")
    none = docs.limit(0)
    assert held(importance.ranked(docs, none)) == plain([tuple(r) for r in docs.collect()], [])
    assert importance.ranked(none, docs).count() == 0 and importance.resample(none, docs).count() == 0


def test_equals_its_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()["op13_importance_resampling"])
    got = queries.op13_importance_resampling(spark, path).select(*want.columns)
    assert held(got) == sorted(want.fetchall(), key=str)
