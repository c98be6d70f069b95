"""SimHash near-duplicates: fingerprints, and links by anchor-point covering.

Fingerprints have 64 bits and link at ``threshold`` (3) or fewer differing bits.
Cut into two halves of 32 bits, two linked fingerprints differ by at most one bit
in one of the halves.  The anchors of a half are the words of a perfect Hamming
code on 31 bits with the 32nd bit free: every value is within covering radius 1
of exactly one anchor, its home.  A value within 1 bit of a fingerprint is within
radius + 1 = 2 of that home, so each fingerprint goes to every anchor within 2
(at most 17 of each half), and in each anchor the ones at home are compared with
all that came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, slices, stored, text_bytes, word_spans
from tessera.llm.components import components

SHINGLE = 3
#: Fingerprints at home in an anchor from which its homes are dealt over several groups.
HOT_ANCHOR = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int32)


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, width: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Fingerprint of each text: bit set where over half the shingle hashes have it."""
    raw = _LOWER[raw]
    starts, ends, before = word_spans(raw, offsets)
    # words of a text joined by one space
    lens = ends - starts
    place = np.cumsum(lens + 1) - (lens + 1)
    joined = np.full(int((lens + 1).sum()), 0x20, np.uint8)
    joined[np.repeat(place - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())] = raw[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
    view = memoryview(joined.tobytes())
    words = np.diff(before)
    shingles = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    first = np.repeat(before[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    last = np.minimum(first + width, np.repeat(before[1:], shingles)) - 1
    lo, hi = place[first].tolist(), (place[last] + lens[last]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(lo, hi, strict=True)), U64, len(lo))
    out = np.zeros(len(words), U64)
    full = np.flatnonzero(shingles)
    if len(full):
        at = (np.cumsum(shingles) - shingles)[full]
        parts = hashes.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            for bit in range(8):
                ones = np.add.reduceat(((parts[:, byte] >> bit) & 1).astype(np.int32), at)
                out[full] |= (2 * ones > shingles[full]).astype(U64) << U64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long).  Null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fp = fingerprints_of(*text_bytes(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _half(fp: Column, half: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))


def anchors(fps: DataFrame) -> DataFrame:
    """(half, anchor, home, fp): each fingerprint at all anchors of both halves
    within covering radius plus one.

    The syndrome of the low 31 bits is the xor of the numbers 1..31 of the bits
    set; it names the bit to flip for the nearest code word.  The code words at
    distance two flip bits i and j with i xor j equal to it.
    """
    parity = lambda x, k: F.bit_count(x.bitwiseAND(F.lit(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)))) % 2
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).withColumn("x", F.when(F.col("half") == 0, _half(F.col("fp"), 0)).otherwise(_half(F.col("fp"), 1)))
    syndrome = sum((parity(F.col("x"), k) * (1 << k) for k in range(1, 5)), parity(F.col("x"), 0))
    named = halves.withColumn("s", syndrome.cast("int"))
    bit = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1))
    home = F.col("x").bitwiseXOR(bit(F.col("s")))
    other = home.bitwiseXOR(F.lit(1 << 31))
    # i from 1 to 31, j = i xor s above i: the pairs that mend the syndrome by two flips
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (F.col("s") != 0) & (i.bitwiseXOR(F.col("s")) > i))
    two = F.transform(pairs, lambda i: F.col("x").bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(F.col("s")))))
    return named.select("half", "fp", home.alias("at_home"), F.explode(F.concat(F.array(home, other), two)).alias("anchor")).select(
        "half", "anchor", (F.col("anchor") == F.col("at_home")).alias("home"), "fp"
    )


def links_within(homes: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join what is linked in one anchor: a spanning set, not all pairs."""
    label = np.arange(len(fps))
    out_a, out_b = [], []
    for at in homes:
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[at]) <= threshold)
        found = np.unique(label[near])
        if len(found) > 1:
            low = found[0]
            label[np.isin(label, found[1:])] = low
            out_a += [fps[low]] * (len(found) - 1)
            out_b += fps[found[1:]].tolist()
    return np.array(out_a, U64), np.array(out_b, U64)


def links(fps: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that join all that link, directly or in steps."""
    if threshold > 3:
        raise ValueError("two halves cover at most 3 differing bits")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # distinct fingerprints are few bytes in few partitions, but each becomes 34 rows, which estimates
    # do not see: without the hint they are broadcast, as planned or by adaptive execution
    dealt = anchors(fps.select("fp").distinct().repartition(n)).hint("merge")
    # only anchors with someone at home and a second fingerprint can link
    sizes = dealt.groupBy("half", "anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 AND homes > 0")
    groups = F.ceil(F.col("homes") / HOT_ANCHOR).cast("int")
    kept = dealt.join(sizes, ["half", "anchor"]).withColumn("groups", groups)
    own = F.pmod(F.xxhash64("fp"), F.col("groups")).cast("int")
    # the homes of a hot anchor are dealt over groups; everything that came is in each group
    dealt_out = kept.select("half", "anchor", "home", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    rows = dealt_out.select("half", "anchor", "salt", (F.col("home") & (F.col("own") == F.col("salt"))).alias("home"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            home = np.concatenate([h[3] for h in held]).astype(bool)
            fp = np.concatenate([h[4] for h in held]).view(U64)
            a, b = links_within(np.flatnonzero(home), fp, threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            for lo, hi in zip(np.r_[0, new], np.r_[new, len(cols[0])], strict=True):
                key = (cols[0][lo], cols[1][lo], cols[2][lo])
                if held and (held[0][0][0], held[0][1][0], held[0][2][0]) != key:
                    yield from close()
                    held.clear()
                held.append([c[lo:hi] for c in cols])
        if held:
            yield from close()

    return rows.repartition(n, "half", "anchor", "salt").sortWithinPartitions("half", "anchor", "salt").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id
    reachable over links.  Texts without words share fingerprint zero and link
    like any other; null doc_ids are ignored as component ids (null if a group has no
    other); repeated rows stay.  Ids may have any type with an order.  Other columns
    are not looked at.  An empty table gives an empty table.  Tables with a row per text
    are joined by shuffles: files of many copies are far smaller than their rows."""
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = stored(components(links(classes, threshold)), "components")
    labelled = classes.hint("merge").join(joined, classes.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = labelled.hint("merge").join(smallest, "component").select("fp", "component_id")
    return marked.hint("merge").join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the smallest doc_id
    stays, with all rows that carry it; rows without a doc_id can't be told apart and stay."""
    found = near_duplicates(docs, threshold, id_col, text_col)
    kept = found.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    # names of our own only, whatever the columns are called
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"))
    left = rows.join(kept, F.col("id").eqNullSafe(F.col("kept")), "left_semi")
    return left.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
