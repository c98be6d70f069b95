"""The classifiers' sample: its bound, and its texts beside their labels."""

import numpy as np

from tessera.llm import quality


def test_sample_has_long_texts_up_to_its_bound(spark, monkeypatch):
    monkeypatch.setattr(quality, "PART_BYTES", 1_000_000, raising=False)
    texts = spark.range(60).selectExpr("id AS doc_id", "repeat(concat('word', cast(id AS string), ' '), 50000) AS text")
    labels = spark.range(60).selectExpr("id AS doc_id", "cast(id AS int) AS quality")
    table, parts = quality.labelled_sample(texts, labels, ["quality"])
    assert table.num_rows == 60
    got = [raw[a:b].tobytes().split(b" ")[0].decode() for raw, at in parts for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [f"word{q}" for q in np.asarray(table["quality"]).tolist()]
    table, parts = quality.labelled_sample(texts, labels, ["quality"], size=20_000_000)
    sizes = np.concatenate([np.diff(at) for _, at in parts])
    assert len(sizes) == table.num_rows and 19_000_000 < sizes.sum() <= 20_000_000
