"""Quality rules: counts over whole texts and a calibrated hashed n-gram logistic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import distinct_words, exact_names, plain, slices, stored, text_bytes, word_spans
from tessera.llm.textfeatures import Sample, fit_sparse, dot, hashed

#: Labelled rows that a classifier is fitted on, at most; chosen by a hash of doc_id.
FIT_ROWS = 3000
#: Total bytes of text in them, at most; no text of more than a fiftieth of this many characters is fitted on.
FIT_BYTES = 24_000_000
#: Bytes of text that the driver holds at once.
PART_BYTES = 2_000_000
#: Rows of the sample held back to calibrate the probability.
HELD_OUT = 0.25
#: A document whose calibrated probability of quality is below this is rejected.
THRESHOLD = 0.5
WINDOW = 5

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def per_owner(owner: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(owner, minlength=texts).astype(np.int64)


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text;
    equal lines and words are told by their bytes."""
    texts = len(offsets) - 1
    starts, ends, before = word_spans(raw, offsets)
    words = np.diff(before)

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag, dtype=np.int64)]
        return total[offsets[1:]] - total[offsets[:-1]]

    lead = (raw & 0xC0) != 0x80
    total = np.r_[0, np.cumsum(lead, dtype=np.int64)]
    in_words = np.r_[0, np.cumsum(total[ends] - total[starts])]
    # lines with a word: between line breaks and text ends
    breaks = np.flatnonzero(raw == 0x0A)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(raw)]
    line_end = np.minimum(np.r_[line_start[1:], len(raw)], len(raw))
    line_end = np.where(np.isin(line_end - 1, breaks), line_end - 1, line_end)
    owner = np.searchsorted(offsets, line_start, "right") - 1
    has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    view = raw.tobytes()
    lines = [(t, view[a:b]) for t, a, b in zip(owner[has].tolist(), line_start[has].tolist(), line_end[has].tolist(), strict=True)]
    dup_lines = per_owner(owner[has], texts) - np.bincount([t for t, _ in set(lines)], minlength=texts).astype(np.int64)
    # words in windows of five that are found twice in the text
    text = np.repeat(np.arange(texts), words)
    repeat = np.zeros(texts, np.int64)
    if len(text) >= WINDOW:
        word, _ = distinct_words(raw, starts, ends)
        at = np.flatnonzero(text[: len(text) - WINDOW + 1] == text[WINDOW - 1 :])
        name = exact_names([word[at + k] for k in range(WINDOW)] + [text[at]])
        order = np.argsort(name)
        same = name[order[1:]] == name[order[:-1]]
        twice = np.zeros(len(name), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        repeat = per_owner(text[covered], texts)
    return {
        "n_words": words.astype(np.int64),
        "word_chars": in_words[before[1:]] - in_words[before[:-1]],
        "n_symbols": per_text(_SYMBOL[raw]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
    }


@dataclass
class Model:
    word: np.ndarray
    char: np.ndarray
    bias: float
    scale: float
    shift: float
    held_out_accuracy: float

    def probability(self, features) -> np.ndarray:
        z = self.scale * (dot(features, self.word, self.char) + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, columns: list[str], rows: int = FIT_ROWS, size: int = FIT_BYTES, longest: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[pa.Table, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Labels, and in parts the texts, of at most ``rows`` labelled documents and
    ``size`` bytes, the first by a hash of their ids, and none of more than ``longest``
    characters (size / 50 if not given).  Bounded whatever the tables hold."""
    longest = size // 50 if longest is None else longest
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    labels = labels.select(F.col(f"`{id_col}`").alias("doc_id"), *columns)
    marked = labels.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).select("doc_id", *columns)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", *columns).limit(rows)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = text.join(F.broadcast(chosen), "doc_id").where(F.length("text") <= longest)
    first = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), *columns).limit(rows)
    # one partition, so the ids count its rows
    kept = stored(first.select(F.monotonically_increasing_id().alias("nth"), F.octet_length("text").alias("bytes"), "text", *columns), "sample")
    table = kept.drop("text").orderBy("nth").toArrow()
    upto = np.cumsum(np.asarray(table["bytes"], np.int64))
    table = table.slice(0, int(np.searchsorted(upto, size, "right")))

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nth, lo = np.asarray(table["nth"]), 0
        while lo < len(nth):
            hi = max(lo + 1, int(np.searchsorted(upto[: len(nth)], (upto[lo - 1] if lo else 0) + PART_BYTES, "right")))
            part = kept.where(F.col("nth").between(int(nth[lo]), int(nth[hi - 1]))).orderBy("nth").select("text").toArrow()
            yield text_bytes(part["text"].combine_chunks())
            lo = hi

    return table, parts()


def logistic(p: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(p, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The classifier of label ``quality``, or None where the sample has one class only.
    Fitted on the bounded sample that :func:`labelled_sample` takes; all else covers all rows.

    Classes weigh alike.  Probabilities are calibrated by Platt's scaling on rows
    held out from the fit.
    """
    table, parts = labelled_sample(docs, labels, ["quality"], id_col=id_col, text_col=text_col)
    y = np.asarray(table["quality"]).astype(float) > 0
    if y.all() or not y.any():
        return None
    held = (np.arange(len(y)) % round(1 / HELD_OUT)) == 0
    sample = Sample(parts)
    weight = np.where(y, 0.5 / max(1, (y & ~held).sum()), 0.5 / max(1, (~y & ~held).sum())) * ~held

    sample.most_weight = weight.max()

    def slope(score, extra):
        d = (logistic(score + extra[0]) - y) * weight
        return d, np.array([d.sum()])

    w, c, bias = fit_sparse(sample, slope, np.zeros(1))
    z = sample.score(w, c) + bias[0]
    scale, shift = platt(z[held], y[held])
    right = (logistic(scale * z + shift) >= 0.5) == y
    return Model(*sample.spread(w, c), float(bias[0]), scale, shift, float(right[held].mean()))


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the calibrated log odds at the classes' own shares, by
    Newton steps.  Scores that are not informative keep slope one."""
    if not y.any() or y.all():
        return 1.0, 0.0
    n1, n0 = y.sum(), (~y).sum()
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = 1 / len(y)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = logistic(a * z + b)
        g = (p - target) * weight
        v = p * (1 - p) * weight + 1e-9
        hess = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * z).sum() + 1e-6 * (a - 1), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 and np.isfinite(a + b) else (1.0, 0.0)


def rules(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, quality, kept) of each row, without an exchange.

    Null texts are empty; a text without words has base_failed.  ``quality`` is
    the calibrated probability (null without a model, and then the base decides); one
    that equals the threshold is kept.  Texts are read whole.  Repeated rows get equal results, an
    empty table gives an empty one, null ids stay, other columns are not looked at.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed number of slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, offsets = text_bytes(batch.column(1))
                c = base_counts(raw, offsets)
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                p = m.probability(hashed(raw, offsets)) if m else np.ones(len(failed))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(v) for v in c.values()), pa.array(failed), pa.array(p, mask=np.full(len(p), m is None)), pa.array(~failed & (p >= threshold))],
                    ["doc_id", *c, "base_failed", "quality", "kept"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
    )


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, each by itself; columns and their names as they are.
    Nulls, empty and repeated texts, ties and empty tables as in :func:`rules`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                raw, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
                c = base_counts(raw, offsets)
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                p = m.probability(hashed(raw, offsets)) if m else np.ones(len(failed))
                yield batch.filter(pa.array(~failed & (p >= threshold)))

    table = plain(docs)
    return table.mapInArrow(run, table.schema).toDF(*docs.columns)
