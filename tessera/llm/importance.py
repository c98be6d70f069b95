"""Resampling documents towards a target distribution, weights added up from bit planes."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import U64, distinct_words, partitions, plain, slices, stored, text_bytes, word_spans

BUCKETS = 10_000
#: 64-bit words of a plane: one bit for each bucket.
LANES = -(-BUCKETS // 64)
#: Bytes of one text that are looked at together; longer texts go in pieces that end between words.
PIECE = 1 << 21
#: Documents whose planes are held at once.
GROUP = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


# -- crc32 of joined words ----------------------------------------------------------
# Appending bytes is linear: crc(a + b) = Z(crc(a), len(b)) ^ crc(b), where Z feeds
# zeros.  Z over 2**k zeros is four look-ups, one for each byte of the register.


def _zeros(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


def _tables(powers: int = 31) -> list[np.ndarray]:
    at = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    one = at.copy()
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    out = [one]
    for _ in range(powers):
        out.append(_zeros(out[-1], out[-1]))
    return out


_ZEROS = _tables()


def crc_joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of texts whose halves have these, the second of ``length`` bytes."""
    out, k = first.copy(), 0
    while len(length) and (int(length.max()) >> k):
        on = np.flatnonzero(length >> k & 1)
        out[on] = _zeros(out[on], _ZEROS[k])
        k += 1
    return out ^ second


# -- features -------------------------------------------------------------------------


def buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the bucket of each word and word pair, and the words of each text."""
    low = _LOWER[raw]
    starts, ends, before = word_spans(low, offsets, _BETWEEN)
    index, words = distinct_words(low, starts, ends, _BETWEEN)
    one = np.array([zlib.crc32(w) for w in words.to_pylist()], np.uint32)[index]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    pair = np.flatnonzero(text[:-1] == text[1:])
    blank = np.full(len(pair), zlib.crc32(b" "), np.uint32)
    head = crc_joined(one[pair], blank, np.ones(len(pair), np.int64))
    two = crc_joined(head, one[pair + 1], (ends - starts)[pair + 1])
    return np.concatenate([text, text[pair]]), np.concatenate([one, two]).astype(np.int64) % BUCKETS, np.diff(before)


def _pieces(raw: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in pieces, and the words at the front of each that belong to the
    piece before: the last word is repeated, for the pair that it begins."""
    free = np.flatnonzero(_BETWEEN[_LOWER[raw]])
    lo, carried = 0, np.empty(0, np.uint8)
    while lo < len(raw):
        k = int(np.searchsorted(free, lo + PIECE))
        hi = int(free[k]) + 1 if k < len(free) else len(raw)
        piece = np.concatenate([carried, np.frombuffer(b" ", np.uint8), raw[lo:hi]])
        yield piece, int(len(carried) > 0)
        starts, ends, _ = word_spans(_LOWER[piece], np.array([0, len(piece)]), _BETWEEN)
        carried = piece[starts[-1] : ends[-1]] if len(starts) else carried
        lo = hi


def counted(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of what the texts hold, and their words."""
    if len(offsets) == 2 and len(raw) > PIECE:
        total, words = np.zeros(BUCKETS, np.int64), 0
        for piece, again in _pieces(raw):
            _, bucket, n = buckets(piece, np.array([0, len(piece)]))
            total += np.bincount(bucket[again:], minlength=BUCKETS)
            words += int(n[0]) - again
        held = np.flatnonzero(total)
        return np.zeros(len(held), np.int64), held, total[held], np.array([words])
    text, bucket, words = buckets(raw, offsets)
    code, count = np.unique(text * BUCKETS + bucket, return_counts=True)
    return code // BUCKETS, code % BUCKETS, count, words


# -- bit planes -----------------------------------------------------------------------


def bit_rows(row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
    """Rows of ``LANES`` words with the bits of the given buckets set."""
    out = np.zeros((rows, LANES), U64)
    np.bitwise_or.at(out, (row, bucket >> 6), U64(1) << (bucket & 63).astype(U64))
    return out


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(power or its negative, plane) of each bit of the gains in two's complement: the sign's bit counts below zero."""
    top = max(int(np.abs(gains).max(initial=0)).bit_length(), 1)
    every = np.arange(len(gains))
    planes = []
    for j in range(top + 1):
        on = every[gains >> j & 1 == 1]
        planes.append((-(1 << j) if j == top else 1 << j, bit_rows(np.zeros(len(on), np.int64), on, 1)[0]))
    return planes


def summed(text: np.ndarray, bucket: np.ndarray, count: np.ndarray, texts: int, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The sum of count * gain of each text: bit k of the counts is a plane, which meets
    each plane of the gains; the bits that stay are counted and weigh both powers of two."""
    out = np.zeros(texts, np.int64)
    for k in range(int(count.max(initial=0)).bit_length()):
        on = count >> k & 1 == 1
        have, row = np.unique(text[on], return_inverse=True)  # texts without this bit have no plane
        for lo in range(0, len(have), GROUP):
            part = (row >= lo) & (row < lo + GROUP)
            plane = bit_rows(row[part] - lo, bucket[on][part], min(GROUP, len(have) - lo))
            for power, gain in planes:
                out[have[lo : lo + GROUP]] += np.bitwise_count(plane & gain).sum(1, dtype=np.int64) * (power << k)
    return out


# -- the operator ---------------------------------------------------------------------


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket: one sum of BUCKETS numbers for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                _, bucket, count, _ = counted(*text_bytes(batch.column(0)))
                np.add.at(total, bucket, count)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    rows = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "bucket long, n long")
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(spark, gain: np.ndarray, seed: int):
    """(ids, texts) of a batch -> n_words, n_features, weight and score of each."""
    shared = spark.sparkContext.broadcast(gain_planes(gain))  # a few planes of BUCKETS bits

    def score(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        text, bucket, count, words = counted(*text_bytes(texts))
        n = np.bincount(text, count, len(words)).astype(np.int64)
        weight = summed(text, bucket, count, len(words), shared.value) // np.maximum(n, 1)
        return words.astype(np.int64), n, weight, weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)

    return score


def scores(docs: DataFrame, gain: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row, without an exchange."""
    score = _scorer(docs.sparkSession, gain, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, score(batch.column(0), batch.column(1)))], ["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long, score long"
    )


def ranked(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs``; rank counts the
    drawn rows, floor(percent * N / 100) of the N with at least ``least_words`` words, by
    falling score, ties to the smaller id, and is null for all others.

    Null and empty texts have no features and weight 0; a null id hashes like an empty
    one and comes last among equal scores.  Rows that repeat each count as one, also in
    the corpus; equal ones are ranked one after the other.  Empty tables are allowed on
    both sides, other columns are not looked at.

    Texts are read twice and never shuffled.  Ranks come from a range partitioning by
    score, id and row number, so that no score, id or repeated row fills a task.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = stored(scores(docs, gain, seed, id_col, text_col).withColumn("nth", F.monotonically_increasing_id()), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    first = _numbered(able).select("doc_id", "n_features", "weight", "score", F.when(F.col("number") <= drawn, F.col("number")).alias("rank"))
    rest = rows.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return first.unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """The drawn rows of ``docs``, columns as they are.

    The last drawn row of :func:`ranked` is the bar; rows that equal it in score and id
    are all drawn, so copies with one id may exceed the share by their number.  Nulls,
    empty texts and empty tables as there.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = stored(scores(docs, gain, seed, id_col, text_col).withColumn("nth", F.monotonically_increasing_id()), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    if not drawn:
        return docs.limit(0)
    last = _numbered(able).where(F.col("number") == drawn).select("score", "doc_id").first()
    score, table = _scorer(docs.sparkSession, gain, seed), plain(docs)
    i, t = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, f"c{t}"):
                words, _, _, got = score(batch.column(i), batch.column(t))
                keep = (words >= least_words) & (got >= last.score)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, "score"]).filter(pa.array(keep))

    kept = table.mapInArrow(run, StructType([*table.schema.fields, StructField("score", LongType())]))
    above = F.col("score") > last.score
    if last.doc_id is not None:  # null ids come last among equal scores
        above |= F.col(f"c{i}") <= F.lit(last.doc_id)
        kept = kept.where(above)
    return kept.drop("score").toDF(*docs.columns)


def _numbered(able: DataFrame) -> DataFrame:
    """``able(score, doc_id, nth, ...)`` with the number of each row in the order of
    falling score, id and nth."""
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("nth")]
    # ``at`` is the number of a row's partition, shifted by 33 bits, and its place there
    placed = stored(able.repartitionByRange(partitions(able), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    sizes = sorted((p, n) for p, n in placed.groupBy("part").count().collect())  # a row for each partition
    starts = able.sparkSession.createDataFrame(list(zip([p for p, _ in sizes], accumulate([n for _, n in sizes], initial=0))), "part long, before long")
    return placed.join(F.broadcast(starts), "part").withColumn("number", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
