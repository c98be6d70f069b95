"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One set of hashed-text weights gives each text a score; K-1 ordered thresholds cut
it into K grades: P(grade <= k) is the logistic of threshold k minus the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, text_bytes
from tessera.llm.quality import FIT_BYTES, FIT_ROWS, labelled_sample, logistic
from tessera.llm.textfeatures import Sample, dot, fit_sparse, hashed

#: A document is selected if its chance of at least this grade is at least SELECT.
GOOD_GRADE = 2
SELECT = 0.45


@dataclass
class OrdinalModel:
    word: np.ndarray
    char: np.ndarray
    thresholds: np.ndarray

    def tails(self, features) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, one row per text."""
        return logistic(dot(features, self.word, self.char)[:, None] - self.thresholds[None, :])


def ordered(raw: np.ndarray) -> np.ndarray:
    """Thresholds from free numbers: the first, then positive gaps."""
    return np.cumsum(np.r_[raw[:1], np.exp(np.clip(raw[1:], -20, 20))])


def slopes(y: np.ndarray, grades: int, weight: float):
    """(score, extra) -> slopes of the mean negative log-likelihood of the grades ``y``."""

    def slope(score, extra):
        theta = np.r_[-np.inf, ordered(extra), np.inf]
        hi, lo = logistic(theta[y + 1] - score), logistic(theta[y] - score)
        p = np.maximum(hi - lo, 1e-9)
        fhi, flo = hi * (1 - hi), lo * (1 - lo)
        d = (fhi - flo) / p * weight
        dt = np.bincount(y, -fhi / p * weight, grades)[:-1] + np.bincount(y, flo / p * weight, grades)[1:]
        back = np.cumsum(dt[::-1])[::-1].copy()
        back[1:] *= np.exp(np.clip(extra[1:], -20, 20))
        return d, back

    return slope


def fit(docs: DataFrame, ratings: DataFrame, grades: int, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> OrdinalModel | None:
    """Fitted on at most ``rows`` rated documents and ``size`` bytes of ``ratings(doc_id,
    grade 0 .. grades-1)``; None where the sample has one grade only."""
    table, parts = labelled_sample(docs, ratings, ["grade"], rows, size)
    y = np.asarray(table["grade"]).astype(int)
    if len(np.unique(y)) < 2:
        return None
    sample = Sample(parts)
    share = np.bincount(y, minlength=grades) / len(y)
    weight = 1 / len(y)
    sample.most_weight = weight * 2

    start = np.clip(np.cumsum(share)[:-1], 0.02, 0.98)
    cut = np.maximum.accumulate(np.log(start / (1 - start)))
    w, c, extra = fit_sparse(sample, slopes(y, grades, weight), np.r_[cut[:1], np.log(np.maximum(np.diff(cut), 0.05))], rounds=150, l1=2e-3)
    return OrdinalModel(*sample.spread(w, c), ordered(extra))


def grade(docs: DataFrame, model: OrdinalModel | None, good: int = GOOD_GRADE, select: float = SELECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_good, kept) of each row, without an exchange.

    Null texts are scored as empty ones.  Without a model the first two are null
    and every row is kept.  A chance that equals ``select`` is kept; texts are read whole,
    repeated rows get equal results, an empty table gives an empty one, null ids stay,
    other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed number of slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                n = batch.num_rows
                tails = m.tails(hashed(*text_bytes(batch.column(1)))) if m else np.ones((n, good))
                none = np.full(n, m is None)
                chance = tails[:, min(good, tails.shape[1]) - 1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(tails.sum(axis=1), mask=none), pa.array(chance, mask=none), pa.array(chance >= select)],
                    ["doc_id", "expected_grade", "p_good", "kept"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"doc_id {kind}, expected_grade double, p_good double, kept boolean"
    )
