"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import bpe, mixing, ordinal, quality, tokenfile
from tessera.llm.textfeatures import CHAR_SLOTS, WORD_SLOTS

GOOD = "the quiet garden wall was built long ago by three masons who came from the hills with carts of stone"
ROWS = [(1, GOOD, "a", 1, True), (1, GOOD, "a", 1, True), (2, None, None, 2, False), (3, "", "b", 3, None), (None, GOOD + " again", "b", 4, True), (5, "word " * 300_000, "a", 5, True)]
NAMES = "`doc.id` long, `te.xt` string, source string, kept int, `x.y` boolean"
ID, TEXT = dict(id_col="doc.id"), dict(text_col="te.xt")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, NAMES).repartition(3)


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def model():
    rng = np.random.default_rng(0)
    return ordinal.OrdinalModel(rng.normal(size=WORD_SLOTS).astype("f4"), rng.normal(size=CHAR_SLOTS).astype("f4"), np.array([-0.5, 0.5]))


def test_grades(odd):
    m = model()
    out = ordinal.grade(odd, m, **ID, **TEXT).collect()
    assert len(out) == len(ROWS) and len({(r.expected_grade, r.p_good, r.kept) for r in out if r.doc_id == 1}) == 1
    by = {r.doc_id: r for r in out}
    assert by[2].expected_grade == by[3].expected_grade and all(0 <= r.expected_grade <= 2 for r in out)
    tie = by[2].p_good
    assert {r.doc_id: r.kept for r in ordinal.grade(odd, m, select=tie, **ID, **TEXT).collect()}[2] is True  # an equal chance is kept
    assert all(r.kept and r.p_good is None for r in ordinal.grade(odd, None, **ID, **TEXT).collect())
    assert ordinal.grade(odd.limit(0), m, **ID, **TEXT).count() == 0


def test_rules(odd):
    m = quality.Model(model().word, model().char, 0.0, 1.0, 0.0, 1.0)
    out = quality.rules(odd, m, **ID, **TEXT).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    assert by[2].base_failed and by[3].base_failed and by[5].base_failed and by[5].n_words == 300_000 and not by[1].base_failed
    assert {r.doc_id: r.kept for r in quality.rules(odd, m, by[1].quality, **ID, **TEXT).collect()}[1]  # an equal probability is kept
    kept = quality.keep_good(odd, None, **TEXT)
    assert kept.columns == odd.columns and rows(kept) == sorted(str(r) for r in ROWS if r[1] and GOOD in r[1])
    assert quality.keep_good(odd.limit(0), m, **TEXT).count() == 0 and quality.rules(odd.limit(0), m, **ID, **TEXT).count() == 0


def test_encoding(odd, spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.digest(odd, path, P.PATTERN, **ID, **TEXT).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ROWS) and by[2].n_tokens == by[3].n_tokens == 0 and by[2].ids_sha256 == by[3].decoded_sha256
    assert len({tuple(r) for r in out if r.doc_id == 1}) == 1
    assert bpe.digest(odd.limit(0), path, P.PATTERN, **ID, **TEXT).count() == 0


def test_token_files(odd, spark):
    where = tokenfile.write_tokens(odd, P.path("byte_bpe_50k.json"), **ID, **TEXT)
    out = sorted(tokenfile.token_digests(spark, where).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 1, 1, 2, 3, 5] and out[3].n_tokens == out[4].n_tokens == 1
    assert out[1].ids_crc32 == out[2].ids_crc32 and all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))
    assert tokenfile.token_digests(spark, tokenfile.write_tokens(odd.limit(0), P.path("byte_bpe_50k.json"), **ID, **TEXT)).count() == 0


def test_mixing(odd):
    mixed = mixing.mix(odd, **ID, **TEXT)
    assert mixed.columns == odd.columns and mixed.count() > 0
    sizes = mixing.mix_sizes(odd, **ID, **TEXT).collect()
    assert len(sizes) == len(ROWS) and {r.taken for r in sizes if r.doc_id in (2, 3)} == {0}


def test_gradient_of_the_ordinal_loss():
    """The slopes that the fit follows are those of the loss, by finite differences."""
    rng = np.random.default_rng(1)
    y, score, extra = rng.integers(0, 3, 50), rng.normal(size=50), np.array([-0.4, 0.2])

    def loss(score, extra):
        theta = np.r_[-np.inf, ordinal.ordered(extra), np.inf]
        logistic = lambda z: 1 / (1 + np.exp(-z))
        return -np.log(logistic(theta[y + 1] - score) - logistic(theta[y] - score)).mean()

    d, back = ordinal.slopes(y, 3, 1 / 50)(score, extra)
    for k in range(5):
        step = np.eye(50)[k] * 1e-6
        assert d[k] == pytest.approx((loss(score + step, extra) - loss(score - step, extra)) / 2e-6, abs=1e-6)
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        assert back[k] == pytest.approx((loss(score, extra + step) - loss(score, extra - step)) / 2e-6, abs=1e-6)
